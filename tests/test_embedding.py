"""Outages of an encoder beside texts that it refuses."""

from pyspark.sql import functions as F

from termloom.operators import embedding
from termloom.operators.embedding import embed, hashed_bag_encoder


def embedded(spark, encoder, texts):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "2")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "i int, q string").coalesce(1)
        return [r.v for r in df.select("i", embed(F.col("q"), encoder).alias("v")).orderBy("i").collect()]
    finally:
        spark.conf.set(conf, before)


def test_refused_texts_are_no_outage(spark):
    got = embedded(spark, hashed_bag_encoder(8), ["?!"] * (4 * embedding.GIVE_UP) + ["good text"])
    assert got[-1] is not None and not any(got[:-1])


def test_an_outage_is_given_up(spark):
    def dropping():
        calls = []

        def encode(texts):
            calls.append(texts)
            if len(calls) <= 3 * embedding.GIVE_UP:  # a batch of two, then text by text
                raise ConnectionError("no answer")
            return [[1.0] for _ in texts]

        return encode

    assert not any(embedded(spark, dropping, ["good text"] * (2 * embedding.GIVE_UP + 4)))
