import collections

from llm_cases import frame, prose
from pyspark.sql import functions as F

from keyloom.llm import mixing


def test_expand_keeps_to_max_epochs(spark):
    texts = [(i, "", "a") for i in range(40)] + [(100, prose(1, 5), "a"), (101, prose(2, 4), "a")]
    texts += [(200 + i, prose(10 + i, 60), "b") for i in range(30)]
    keys = {r.doc_id: r.k for r in frame(spark, texts).select("doc_id", mixing.order_key(F.col("doc_id"), 17).alias("k")).collect()}
    assert min(keys[i] for i in range(40)) < min(keys[100], keys[101])  # a document without words heads the order
    n = collections.Counter(r.doc_id for r in mixing.expand(frame(spark, texts)).collect())
    assert n[100] == n[101] == 3 and {n[i] for i in range(40)} == {3}
