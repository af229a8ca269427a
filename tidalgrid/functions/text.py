"""Text columns: cleaning, regex nets, shape, media kind and label parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import CANDIDATE_TERMS, REMOVED_MARKERS, TIER1_TERMS
from .labels import first_match


def clean_removed(text: Column) -> Column:
    """Empty string in place of NULL or a removal marker."""
    return F.when(F.trim(text).isin(REMOVED_MARKERS), F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def any_of(terms: Sequence[str]) -> str:
    return "(?i)(?:" + "|".join(terms) + ")"


def matches(text: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(text.rlike(any_of(terms)), F.lit(False))


def lexical_nets(
    text: Column, strict: Sequence[str] = TIER1_TERMS, broad: Sequence[str] = CANDIDATE_TERMS
) -> tuple[Column, Column]:
    return matches(text, strict), matches(text, broad)


def no_signal_reason(text: Column) -> Column:
    """Why a text cannot carry a label, or NULL when it can."""
    body = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(body, r"https?://\S+", ""))
    return first_match(
        [
            (body.isin("", "[removed]", "[deleted]"), "removed"),
            (bare == "", "url_only"),
            (~bare.rlike(r"[\p{L}\p{N}]"), "symbols_only"),
        ]
    )


def truncated(text: Column, limit: int, mark: str = " …[trunc]") -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.substring(body, 1, limit), F.lit(mark)))


def line_count(text: Column) -> Column:
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(body == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)


def char_count(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit(""))))


def media_kind(is_self: Column, hint: Column, is_video: Column, url: Column) -> Column:
    """text, image, video or link; the first decisive clue wins."""
    hint = F.lower(F.coalesce(hint, F.lit("")))
    low = F.lower(F.coalesce(url, F.lit("")))
    return first_match(
        [
            (F.coalesce(is_self, F.lit(False)), "text"),
            (hint.contains("image"), "image"),
            (hint.contains("video") | F.coalesce(is_video, F.lit(False)), "video"),
            (low.rlike(r"\.(jpg|jpeg|png|gif|gifv)$"), "image"),
            (low.rlike(r"i\.redd\.it|imgur\.com"), "image"),
            (low.rlike(r"v\.redd\.it|youtube\.com|youtu\.be"), "video"),
            (low != "", "link"),
        ],
        "text",
    )


KNOWN_STANCES = ["pro", "anti", "neutral", "mixed"]


def _truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "y", "t"), F.lit(False))


def parse_labels(df: DataFrame, text: str) -> DataFrame:
    """Add typed label fields and a ``fail_reason`` read from a tolerant JSON label object.

    The object may be wrapped in an array or in prose: the text between the first ``{`` and the
    last ``}`` is used when the whole is not JSON.  ``fail_reason`` is '', 'empty', 'malformed' or
    'missing_fields'.  Each step is a column of its own, so the JSON is parsed once per row.
    """
    empty = F.col("_body").isin("", "[]", "{}", "[ ]", "{ }")
    field = lambda name: F.try_variant_get("_obj", f"$.{name}", "string")
    out = df.withColumn("_body", F.trim(F.coalesce(F.col(text), F.lit(""))))
    inner = F.nullif(F.regexp_extract("_body", r"(?s)\{.*\}", 0), F.lit(""))
    out = out.withColumn("_whole", F.try_parse_json("_body"))
    out = out.withColumn("_any", F.when(F.col("_whole").isNotNull(), F.col("_whole")).otherwise(F.try_parse_json(inner)))
    out = out.withColumn("_kind", F.schema_of_variant("_any"))
    is_list = F.col("_kind").startswith("ARRAY")
    out = out.withColumn("_obj", F.when(is_list, F.try_variant_get("_any", "$[0]", "variant")).otherwise(F.col("_any")))
    out = out.withColumn("_shape", F.schema_of_variant("_obj"))
    reason = (
        F.when(empty, "empty")
        .when(F.col("_any").isNull(), "malformed")
        .when(is_list & F.col("_obj").isNull(), "empty")
        .when(~F.coalesce(F.col("_shape").startswith("OBJECT"), F.lit(False)), "malformed")
        .when(~F.col("_shape").rlike(r"(^OBJECT<|, )about_topic:"), "missing_fields")
        .otherwise("")
    )
    out = out.withColumns({"fail_reason": reason, "_stance": F.lower(F.trim(field("stance"))), "_conf": field("confidence").try_cast("double")})
    ok = F.col("fail_reason") == ""
    out = out.withColumns(
        {
            "about_topic": F.when(ok, _truthy(field("about_topic"))),
            "stance": F.when(ok, F.when(F.col("_stance").isin(KNOWN_STANCES), F.col("_stance")).otherwise("NA")),
            "confidence": F.when(ok, F.least(F.greatest(F.coalesce("_conf", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))),
            "refers_to_parent": F.when(ok, _truthy(field("refers_to_parent"))),
        }
    )
    return out.drop("_body", "_whole", "_any", "_kind", "_obj", "_shape", "_stance", "_conf")
