"""Sums of doubles come out in the order of the file, however it is split."""

import random

from quillspark.plans import suite


def test_ocr_flags_in_file_order(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.randrange(300), k % 7, float(r.randrange(1, 51)), r.choice("ANR")) for k in range(4000)]
    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string"
    place = tmp_path / "lineitem.parquet"
    for k in range(8):
        spark.createDataFrame(rows[k * 500 : (k + 1) * 500], columns).coalesce(1).write.parquet(str(tmp_path / "one"), mode="overwrite")
        place.mkdir(exist_ok=True)
        next((tmp_path / "one").glob("part-*.parquet")).rename(place / f"part-{k}.parquet")
    want: dict[int, list[float]] = {}
    for key, _, quantity, _ in rows:
        kept = want.setdefault(key, [0.0, 0])
        kept[0] += quantity / 50
        kept[1] += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {x.doc_id: (x.mean_conf, x.low_mean) for x in suite.queries()["agg_ocr_flags"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {key: (total / n, total / n < 0.8) for key, (total, n) in want.items()}
