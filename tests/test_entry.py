import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_catalogue():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_training_data_part():
    code = "import sys, sparktrail.catalogue; assert not [m for m in sys.modules if m.startswith('sparktrail.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
