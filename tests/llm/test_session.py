import os
import subprocess
import sys
from pathlib import Path

CODE = """
import tempfile
from paperloom.session import local_session, shared_folder
from paperloom.llm.minhash import near_duplicates
spark = local_session(2, partitions=2, memory="2g")
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None
text = "a b c d e f g h i j"
rows = near_duplicates(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")).collect()
assert {r.component_id for r in rows} == {1} and shared_folder(spark).startswith(tempfile.gettempdir())
"""


def test_without_a_shared_folder(tmp_path):
    """A local session whose configuration names no folder stages in one of its own."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
