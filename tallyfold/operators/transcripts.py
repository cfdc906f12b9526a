"""Calls and conversations: segments by speaker, tone, guidance and risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

SPEAKER = r"^([A-Z][A-Za-z0-9.\-,' ]{2,80}?)\s*:\s*(.+)$"


def segments(texts: DataFrame, key: str) -> DataFrame:
    """key, position, speaker, role, text. A line "Speaker: words" opens a segment, others go on; what stands before the first is lost."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("ord", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    opens = F.col("line").rlike(SPEAKER)
    w = Window.partitionBy(key).orderBy("ord")
    d = lines.withColumn("seg", F.sum(opens.cast("int")).over(w)).where("seg > 0")
    d = d.withColumn("speaker", F.when(opens, F.trim(F.regexp_extract("line", SPEAKER, 1)))).withColumn("part", F.when(opens, F.trim(F.regexp_extract("line", SPEAKER, 2))).otherwise(F.col("line")))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "part"))), lambda p: p["part"]), " ")
    out = d.groupBy(key, "seg").agg(F.max("speaker").alias("speaker"), parts.alias("text"))
    return out.select(key, (F.col("seg") - 1).cast("int").alias("position"), "speaker", T.role(F.col("speaker")).alias("role"), "text")


def full_text(segs: DataFrame, key: str) -> DataFrame:
    """key, text: a call's segments in order, one to a line."""
    return segs.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), "\n").alias("text"))


def of_role(segs: DataFrame, name: str) -> DataFrame:
    return segs.where(F.col("role") == name)


def sentiment(text: Column) -> dict[str, Column]:
    """positive, negative, total words, net (share, four places), polarity, confidence."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    pos, neg, n = F.size(F.filter(words, lambda w: w.isin(L.POSITIVE))), F.size(F.filter(words, lambda w: w.isin(L.NEGATIVE))), F.size(words)
    net = F.when(n > 0, F.round((pos - neg) / n, 4)).otherwise(0.0)
    return {
        "positive": pos,
        "negative": neg,
        "total": n,
        "net": net,
        "polarity": F.when(net > 0.005, "positive").when(net < -0.005, "negative").otherwise("neutral"),
        "confidence": F.when(pos + neg >= 50, "high").when(pos + neg >= 20, "medium").when(pos + neg >= 5, "low").otherwise("insufficient"),
    }


def sentences_with(text: Column, words: list[str], cap: int = 10) -> Column:
    """The first cap sentences under 400 characters that contain one of the words."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u001f"), "\u001f")
    return F.slice(F.filter(F.transform(cut, F.trim), lambda s: T.contains_any(F.lower(s), words) & (F.length(s) < 400)), 1, cap)


def analysis(segs: DataFrame, key: str) -> DataFrame:
    """key, net, ceo_net, cfo_net, guidance, risks, speakers (different ones in order)."""
    net = lambda t: sentiment(t)["net"]
    joined = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("position", "text")))), lambda s: s["text"]), "\n")
    g = segs.groupBy(key).agg(joined(F.lit(True)).alias("all"), joined(F.col("role") == "CEO").alias("ceo"), joined(F.col("role") == "CFO").alias("cfo"), F.transform(F.sort_array(F.collect_list(F.struct("position", "speaker"))), lambda s: s["speaker"]).alias("who"))
    return g.select(key, net(F.col("all")).alias("net"), net(F.col("ceo")).alias("ceo_net"), net(F.col("cfo")).alias("cfo_net"), sentences_with(F.col("all"), L.GUIDANCE).alias("guidance"), sentences_with(F.col("all"), L.RISKS).alias("risks"), F.array_distinct("who").alias("speakers"))
