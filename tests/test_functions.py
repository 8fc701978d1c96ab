import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import bytecode, hexnum, items, text

VALUES = ["0x0", "0x", "0xzz", None, "0x10", "0xFF", hex(2**63 - 1), hex(2**64 - 1), hex(10**20 + 7), hex(2**256 - 1000),
          hex(10**38 - 1), hex(10**38), "0x" + "0" * 63 + "a", hex(2**120 + 5), "plain"]


def test_hex_widths(spark):
    c = F.col("v")
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string").select(
        "v", hexnum.hex_to_long(c).alias("l"), hexnum.hex_to_text(c).alias("t"), hexnum.hex_to_decimal(c).alias("d")).collect()
    for r in rows:
        try:
            want = int(r.v, 16) if r.v and r.v.startswith("0x") else r.v
        except ValueError:
            want = r.v
        assert r.t == (None if want is None else str(want))
        number = want if isinstance(want, int) else None
        assert r.l == (number if number is not None and number < 2**63 else None)
        assert (None if r.d is None else int(r.d)) == (number if number is not None and number < 10**38 else None)


def test_content_hash(spark):
    word = "0x017dfd85d4f6cb4dcd715a88101f7b1f06cd1e009b2327a0809d01eb9c91f231"
    got = spark.createDataFrame([(word,), ("0x12",)], "v string").select(hexnum.content_hash(F.col("v"))).collect()
    assert [r[0] for r in got] == ["QmNSUYVKDSvPUnRLKmuxk9diJ6yS96r1TrAXzjTiBcCLAL", None]


def _select(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_words_and_text(spark):
    word = "a" * 64
    got = _select(
        spark, text.split_to_words(F.lit("0x" + word + "bb")), text.split_to_words(F.lit("0x")), text.split_to_words(F.lit(None).cast("string")),
        text.word_to_address(F.lit("0x" + "00" * 12 + "AB" * 20)), text.word_to_address(F.lit("0xAB")), text.clean_text(F.lit("a\0b")),
        text.split_topics(F.lit(" ")), text.split_topics(F.lit("x,y")), text.to_int_or_null(F.lit("")), text.to_int_or_null(F.lit(" 7")),
        text.data_directory(F.lit('<link rel="data-dir" href="shop"/>')), text.data_directory(F.lit("<html>")), text.number_or_zero(F.lit("n/a")))
    assert got == [["0x" + word, "0xbb"], [], [], "0x" + "ab" * 20, "0xab", "ab", [], ["x", "y"], None, 7, "shop", None, 0.0]


DISPATCH = "6060604052" + "".join(f"8063{s[2:]}1461007857" for s in bytecode.SELECTORS.values())


@pytest.mark.parametrize("code,count,erc20,erc721", [
    ("0x" + DISPATCH + "5b63cafebabe", 7, True, True),
    ("0x0x" + DISPATCH, 7, True, True),
    ("0x6463deadbeef5b63cafebabe", 0, False, False),
    ("0x5b" + DISPATCH, 0, False, False),
    ("44919b8026f38d70437a8eb3be47b06ab1c3e4bf", 0, False, False),
    ("0x", 0, False, False),
    (None, 0, False, False),
])
def test_bytecode(spark, code, count, erc20, erc721):
    df = spark.createDataFrame([(code,)], "c string").select(bytecode.function_sighashes(F.col("c")).alias("s"))
    row = df.select("s", bytecode.is_erc20(F.col("s")), bytecode.is_erc721(F.col("s"))).first()
    assert (len(row[0]), row[1], row[2]) == (count, erc20, erc721)
    assert row[0] == sorted(set(row[0]))


def test_item_fields(spark):
    df = spark.createDataFrame([("0x1", 3, 1438269988), (None, 3, None)], "transaction_hash string, log_index bigint, block_timestamp bigint")
    rows = items.with_item_fields(df, "log").collect()
    assert (rows[0].item_id, rows[0].item_timestamp) == ("log_0x1_3", "2015-07-30T15:26:28Z")
    assert (rows[1].item_id, rows[1].item_timestamp) == (None, None)
    with pytest.raises(ValueError):
        items.item_id("nothing")


def test_converters(spark):
    df = spark.createDataFrame([(5, 1438269988, ["a"]), (6, None, None)], "n bigint, block_timestamp bigint, topics array<string>")
    out = items.apply_converters(df, items.unix_timestamps_to_text, items.integers_to_text(["n"]), items.list_to_columns("topics", "topic"))
    assert [tuple(r) for r in out.collect()] == [("5", "2015-07-30 15:26:28", "a", None, None, None), ("6", None, None, None, None, None)]
