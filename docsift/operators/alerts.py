"""From hits to alerts: detector priority, alert text, alert records and their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_bytes
from .markers import hit

#: Detectors by priority; the first hit counts.
PRIORITY = ("electronic", "marker", "layout", "hash", "keyword")
LAYOUT_RULE, LAYOUT_LEVEL, LAYOUT_ALERT, MARKER_ALERT = 3001, 4, 3, 2
# Greatest lengths of alert fields in bytes.
LIMITS = {"id": 20, "rule_desc": 1024, "matched": 512, "context": 512, "file_name": 128}
# Greatest lengths in bytes of the fields on a file's summary and the host that holds it.
ORIGIN = {
    "file_summary": 65535, "company": 256, "computer_name": 256, "org_id": 256, "org_path": 512, "user_name": 256, "user_id": 256, "extend_fields": 65535,
}
# Priority of level names where levels are merged; the highest wins.
LEVEL_PRIORITY = {"unknown": -1, "none": 0, "internal": 1, "confidential": 2, "secret": 3, "top_secret": 4}


def layout_hit() -> Column:
    """The hit of the layout detector, from the columns that score.scored() makes."""
    percent = F.format_string("%.1f%%", F.col("total_score") * 100)
    has = lambda f: F.col(f) != ""
    parts = F.array_compact(F.array(
        F.when(has("title_type"), F.concat(F.lit("文种: "), "title_type")),
        F.when(F.size("org") > 0, F.concat(F.lit("发文机关: "), F.array_join("org", "、"))), F.concat(F.lit("置信度: "), percent),
    ))
    desc = F.concat(F.lit("公文版式检测命中 ("), F.array_join(parts, "; "), F.lit(")"))
    matched = F.array_join(F.array_compact(F.array(*[F.when(has(f), F.col(f)) for f in ("doc_number", "title", "issue_date")])), " | ")
    named = (("发文字号", "doc_number"), ("密级", "secret_level"), ("标题", "title"), ("主送机关", "main_send"), ("成文日期", "issue_date"))
    lines = [F.when(has(f), F.concat(F.lit(f"{n}: "), f)) for n, f in named]
    lines.append(F.when(F.size("org") > 0, F.concat(F.lit("识别机关: "), F.array_join("org", "、"))))
    lines += [F.when(has(f), F.concat(F.lit(f"{n}: "), f)) for n, f in (("抄送", "copy_to"), ("印发", "print_info"))]
    return hit(F.col("is_official"), F.lit(LAYOUT_LEVEL), F.lit(LAYOUT_RULE), desc, matched, F.array_join(F.array_compact(F.array(*lines)), "\n"), LAYOUT_ALERT)


def first_hit(**hits: Column) -> Column:
    """The hit of the first detector by priority; null if none. No shuffle: hits are columns of one row."""
    return F.coalesce(*[hits[k] for k in PRIORITY if k in hits])


def merged_level(levels: Column) -> Column:
    """Of an array of level names the one of highest priority; unknown for none."""
    ranks = F.create_map(*[F.lit(x) for kv in LEVEL_PRIORITY.items() for x in kv])
    names = F.create_map(*[F.lit(x) for k, v in LEVEL_PRIORITY.items() for x in (v, k)])
    best = F.array_max(F.transform(levels, lambda x: F.coalesce(F.try_element_at(ranks, x), F.lit(-1))))
    return F.coalesce(F.try_element_at(names, best), F.lit("unknown"))


def alert_records(
    hits: DataFrame, time: Column, path: Column, name: Column, content: Column, filter_type: int = 1, origin: dict[str, Column] | None = None,
) -> DataFrame:
    """Alert records of rows with a hit column; the id is derived from content, path and rule, so reruns agree.

    Texts are cut to whole characters within the fields' bytes. origin: columns for fields of ORIGIN, where
    file and host are known; the others are null.
    """
    given = origin or {}
    about = [cut_bytes(given.get(f, F.lit(None)).cast("string"), n).alias(f) for f, n in ORIGIN.items()]
    h = lambda f: F.col(f"hit.{f}")
    digest = F.md5(content)
    ident = F.substring(F.sha2(F.concat_ws("|", digest, path, h("rule_id").cast("string")), 256), 1, LIMITS["id"])
    return hits.where("hit is not null").select(
        ident.alias("id"), time.alias("time"), h("rule_id").alias("rule_id"), cut_bytes(h("rule_desc"), LIMITS["rule_desc"]).alias("rule_desc"),
        F.lit(filter_type).alias("filter_type"), h("alert_type").alias("alert_type"), digest.alias("file_md5"), path.alias("file_path"),
        cut_bytes(name, LIMITS["file_name"]).alias("file_name"), F.octet_length(content).cast("bigint").alias("file_size"),
        cut_bytes(h("matched"), LIMITS["matched"]).alias("highlight_text"), cut_bytes(h("context"), LIMITS["context"]).alias("file_desc"),
        h("level").alias("file_level"), *about,
    )


def alert_log(records: DataFrame, day: Column) -> DataFrame:
    """Per day the number of alerts, of distinct files, and the levels seen."""
    return records.groupBy(day.alias("day")).agg(
        F.count("*").alias("alerts"), F.countDistinct("file_md5").alias("files"), F.array_join(F.sort_array(F.collect_set(F.col("file_level").cast("string"))), ",").alias("levels")
    )


def capped(df: DataFrame, by: list[str], value: str, n: int = 128) -> DataFrame:
    """by and items, the n least values in order, as reports carry them; no more than n of a group are gathered."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    few = df.select(*by, value).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("items"))
