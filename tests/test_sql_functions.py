"""SQL functions equal the column expressions and plan without Python."""

from pyspark.sql import functions as F

from larder.functions import sql, text as X
from larder.plans import testdata as D

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "Café-Crème 3,5 % Fett 1,99 A", "2x Müller's Milch 500ml", "T0mate\tñandú", "größe'n / a.b", "x" * 5000, None]


def test_sql_functions_equal_columns(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    lines = D.frame(spark, SF, D.NOISY_LINES).select("raw_text").unionByName(spark.createDataFrame([(x,) for x in ODD], "raw_text string"))
    line = F.col("raw_text")
    both = {
        "normalize_text": ("normalize_text(raw_text)", X.normalize(line)),
        "ascii_fold": ("ascii_fold(raw_text)", X.ascii_fold(line)),
        "override_key": ("override_key(raw_text)", X.override_key(line)),
        "light_stem": ("light_stem(raw_text)", X.light_stem(line)),
        "fat_percent": ("fat_percent(raw_text)", X.fat_percent(line)),
        "hash_bucket": ("hash_bucket(raw_text, 64)", X.hash_bucket(line)),
    }
    assert both.keys() == sql.FUNCTIONS.keys()
    lines.createOrReplaceTempView("receipt_lines")
    asked = spark.sql("SELECT raw_text, " + ", ".join(f"{text} AS {name}" for name, (text, _) in both.items()) + " FROM receipt_lines")
    assert "Python" not in asked._jdf.queryExecution().toString()
    rows = asked.select("raw_text", *both, *(column.alias(f"want_{name}") for name, (_, column) in both.items())).collect()
    assert len(rows) > 200 and any(r.fat_percent for r in rows)
    wrong = [(r.raw_text, name) for r in rows for name in both if r[name] != r[f"want_{name}"]]
    assert not wrong, wrong[:5]
    assert all(r[name] is None for r in rows if r.raw_text is None for name in both)


def test_sql_functions_group_and_filter(spark):
    sql.register(spark)
    spark.createDataFrame([("Milch 1,5% 500ml 0,89 B", 1), ("MILCH 1,5% 0,99 A", 2), ("Brot", 4)], "line string, n int").createOrReplaceTempView("told")
    got = spark.sql("SELECT override_key(line) AS key, sum(n) AS n FROM told GROUP BY override_key(line)").collect()
    assert sorted(r.n for r in got) == [3, 4]
