import os
import shutil
import tempfile

from conftest import SF_SMALL
from tessera.streaming.tagging import tag_stream


def test_stream_tags_like_batch(spark):
    out = tempfile.mkdtemp(prefix="tessera-stream-")
    # A stream reads a folder of arriving files: drop the (small) table file into one.
    src = os.path.join(out, "incoming")
    os.makedirs(src)
    shutil.copy(os.path.join(SF_SMALL, "documents.parquet"), os.path.join(src, "part-0.parquet"))
    q = tag_stream(spark, src, os.path.join(out, "hits"),
                   os.path.join(out, "ckpt"), available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "hits"))
    from tessera.plans.fixtures import Fixture
    from tessera.operators.rules import detect_rules
    fx = Fixture(spark, SF_SMALL)
    want = detect_rules(fx.docs, fx.words)
    key = ["document", "token", "label"]
    assert sorted(tuple(r) for r in got.select(*key).collect()) == sorted(tuple(r) for r in want.select(*key).collect())
