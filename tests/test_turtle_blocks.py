import os
import subprocess
import sys

import pytest

from loomspan.sources.split_turtle import read_split
from loomspan.sources.turtle import TurtleParser
from tests.test_split_turtle import plain, whole


@pytest.mark.parametrize("block", [1, 90, 400])
def test_blocks_of_a_split_give_the_parse_of_the_whole(spark, tmp_path, block):
    (tmp_path / "one.ttl").write_text(whole())
    (tmp_path / "two.ttl").write_text(whole().replace("http://e/", "http://two/"))
    want = {r for f, t in (("one_ttl", whole()), ("two_ttl", whole().replace("http://e/", "http://two/"))) for r in TurtleParser(t, f).parse()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        got = read_split(spark, str(tmp_path / "*.ttl"), block).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert plain(got) == plain(want) and len(got) == len(want)


CODE = """
import resource
from loomspan.sources.split_turtle import summary
from loomspan.sources.turtle import TurtleParser
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
text = '<a> <b> <c> .\\n' * 150000
before = peak()
assert summary(text, '\"\"\"').state == '\"\"\"'
assert len(TurtleParser('<a> <b> \"\"\"' + text + '\"\"\" .', 'x').parse()) == 1
print(peak() - before)
"""


def test_a_text_that_is_no_string_takes_no_memory_for_each_character():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 60
