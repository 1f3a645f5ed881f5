"""Capture, backtrace, replay and the statistics of layers."""

from .backtrace import as_view, backtrace, lineage
from .capture import capture
from .layers import Captured, cached, graph_json, keep_result, layers_of, load, release, save
from .replay import differences, replay, restrict

__all__ = ["Captured", "as_view", "backtrace", "cached", "capture", "differences", "graph_json", "keep_result", "layers_of", "lineage", "load", "release", "replay", "restrict", "save"]
