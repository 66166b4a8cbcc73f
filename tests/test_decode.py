"""Hand-written raw rows, one per decode decision (FIXTURES §3)."""

from pyspark.sql import functions as F

from logloom.operators.decode import attach_block_header, decode_logs, split_valid
from logloom.schema import RAW_BLOCKS, RAW_LOGS

H32 = "ab" * 32
A20 = "cd" * 20


def _raw(spark, rows):
    full = []
    for r in rows:
        base = dict(chain_id=1, block_number=10, log_index=0, transaction_index=0,
                    transaction_hash="0x" + H32, address="0x" + A20, data="0x",
                    ingest_seq=1, t0="0x" + H32, t1=None, t2=None, t3=None, removed=False)
        base.update(r)
        full.append(tuple(base[f.name] for f in RAW_LOGS.fields))
    return spark.createDataFrame(full, RAW_LOGS)


def _decode(spark, rows):
    blocks = spark.createDataFrame([(1, 10, 1000, "0x" + H32)], RAW_BLOCKS)
    out = decode_logs(attach_block_header(_raw(spark, rows), blocks))
    return out.select("log_index", "reject_reason", F.lower(F.hex("address")).alias("address"),
                      F.lower(F.hex("data")).alias("data"), F.lower(F.hex("topic0")).alias("topic0"),
                      F.lower(F.hex("topic1")).alias("topic1"), "removed").orderBy("log_index").collect()


def test_short_address_is_left_padded(spark):
    (r,) = _decode(spark, [dict(address="0x1")])
    assert r.reject_reason is None and r.address == "00" * 19 + "01"


def test_prefix_variants_accepted(spark):
    rows = _decode(spark, [dict(log_index=0, address=A20), dict(log_index=1, address="0X" + A20.upper())])
    assert [r.reject_reason for r in rows] == [None, None]
    assert rows[0].address == rows[1].address == A20


def test_long_and_bad_hex_rejected(spark):
    rows = _decode(spark, [dict(log_index=0, address="0x" + "1" * 42),
                           dict(log_index=1, address="0xzz"),
                           dict(log_index=2, data="0xabc")])
    assert [r.reject_reason for r in rows] == ["address_length", "address_hex", "data_hex"]


def test_empty_data_and_topics(spark):
    rows = _decode(spark, [dict(log_index=0, data="0x"),
                           dict(log_index=1, t0=None),
                           dict(log_index=2, t1="")])
    assert rows[0].data == "" and rows[0].reject_reason is None
    assert rows[1].topic0 == "00" * 32 and rows[1].topic1 is None
    assert rows[2].topic1 is None and rows[2].reject_reason is None


def test_missing_header_index_and_removed(spark):
    rows = _decode(spark, [dict(log_index=None), dict(log_index=5, block_number=11),
                           dict(log_index=6, removed=None), dict(log_index=7, removed=True)])
    by = {r.log_index: r for r in rows}
    assert by[None].reject_reason == "log_index_missing"
    assert by[5].reject_reason == "block_missing"
    assert by[6].removed == 0 and by[7].removed == 1


def test_five_topics_keep_four(spark):
    from logloom.operators.decode import split_topics
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"],), ([],), (None,)], "topics array<string>")
    out = df.select(*[c.alias(f"t{i}") for i, c in enumerate(split_topics(F.col("topics")))]).collect()
    assert tuple(out[0]) == ("a", "b", "c", "d")
    assert tuple(out[1]) == ("", None, None, None)
    assert tuple(out[2]) == ("", None, None, None)


def test_split_valid_separates(spark):
    blocks = spark.createDataFrame([(1, 10, 1000, "0x" + H32)], RAW_BLOCKS)
    d = decode_logs(attach_block_header(_raw(spark, [dict(log_index=0), dict(log_index=1, address="0xzz")]),
                                        blocks))
    good, bad = split_valid(d)
    assert good.count() == 1 and bad.count() == 1
