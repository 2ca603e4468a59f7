"""Explanations of a ranking in words; rankings have at most a hundred rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import escape_markdown, four_places

WORDS = {
    "en": {"head": "Best matches", "mean": "Mean score", "best": "Strongest", "ask": "Explain in English what the suggested titles share with the favourites.", "liked": "Favourites", "got": "Suggested"},
    "ja": {"head": "上位の結果", "mean": "平均値", "best": "最も近い作品", "ask": "好みの作品と提案された作品の共通点を日本語で説明してください。", "liked": "好み", "got": "提案"},
}


def words(locale: str) -> dict:
    return WORDS["ja" if locale.startswith("ja") else "en"]


def offline(ranking: DataFrame, locale: str = "en", shown: int = 5) -> DataFrame:
    """One row, text: the first rows (rk, name, val), the mean over all (what isn't finite counts 0), the first."""
    w = words(locale)
    score = F.when(F.isnan("val") | F.col("val").isNull() | (F.abs("val") == float("inf")), 0.0).otherwise(F.col("val"))
    rows = ranking.select("rk", escape_markdown(F.col("name")).alias("name"), score.alias("val"))
    line = F.concat(F.col("rk").cast("string"), F.lit(". "), F.col("name"), F.lit(": "), four_places(F.col("val")))
    first = F.sort_array(F.collect_list(F.when(F.col("rk") <= shown, F.struct("rk", line.alias("t")))))
    s = rows.agg(F.array_join(F.transform(first, lambda x: x["t"]), "\n").alias("lines"), F.avg("val").alias("mean"), F.min_by("name", "rk").alias("best"))
    return s.select(F.concat(F.lit(f"## {w['head']}\n"), "lines", F.lit(f"\n\n{w['mean']}: "), four_places(F.coalesce("mean", F.lit(0.0))), F.lit(f"\n{w['best']}: "), F.coalesce("best", F.lit("-"))).alias("text"))


def prompt(favourites: DataFrame, ranking: DataFrame, locale: str = "en") -> DataFrame:
    """One row, text: a request for an explanation, with favourites (seq, name) and ranking (rk, name, val)."""
    w = words(locale)
    liked = favourites.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), ", ").alias("liked"))
    line = F.concat("name", F.lit(": "), four_places(F.col("val")))
    got = ranking.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", line.alias("t")))), lambda x: x["t"]), "\n").alias("got"))
    return liked.join(F.broadcast(got)).select(F.concat(F.lit(f"{w['ask']}\n{w['liked']}: "), "liked", F.lit(f"\n{w['got']}:\n"), "got").alias("text"))  # one row each
