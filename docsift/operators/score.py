"""Explainable weighted scores: text, layout, combination, adjustments, verdict."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once

# Weights of text facts, in the order in which they are added.
TEXT_WEIGHTS = {
    "copy_number": 0.04, "doc_number": 0.18, "secret_level": 0.06, "urgency": 0.05, "issuer": 0.08, "title": 0.15, "title_type": 0.05,
    "main_send": 0.08, "attachment": 0.04, "issue_date": 0.12, "copy_to": 0.05, "print_info": 0.05, "org": 0.10, "doctype": 0.05,
    "action": 0.04, "formal": 0.04, "header": 0.03, "footer": 0.03, "prohibited": 0.20,
}
# Weights of layout facts, in the order in which they are added.
STYLE_WEIGHTS = {
    "has_red_text": 0.12, "has_red_header": 0.18, "has_official_fonts": 0.10, "title_font_match": 0.08, "body_font_match": 0.07,
    "is_a4_paper": 0.10, "margin_match": 0.10, "has_centered_title": 0.07, "line_spacing_match": 0.05, "has_seal_image": 0.13,
}
#: Layout facts any of which makes the layout score count.
STYLE_SHOWN = ("has_red_text", "has_red_header", "has_official_fonts", "is_a4_paper", "has_seal_image")
# Confidence bands, and the reason that marks recognised images.
BANDS = ((0.85, "很高"), (0.7, "高"), (0.55, "中"), (0.4, "低"))
LOWEST = "很低"
IMAGE_REASON = "通过OCR提取文本内容"


@dataclass(frozen=True)
class Weights:
    """Threshold, the two parts' weights, and the weights of all facts."""

    threshold: float = 0.6
    text_part: float = 0.55
    style_part: float = 0.45
    text: dict = field(default_factory=lambda: dict(TEXT_WEIGHTS))
    style: dict = field(default_factory=lambda: dict(STYLE_WEIGHTS))

    def validate(self) -> list[str]:
        """What is wrong: numbers outside 0 and 1, parts that don't add up to 1."""
        bad = [f"{k} outside 0 and 1" for k, v in {"threshold": self.threshold, **self.text, **self.style}.items() if not 0 <= v <= 1]
        return bad + ["the parts don't add up to 1"] * (abs(self.text_part + self.style_part - 1) > 0.01)


DEFAULT = Weights()
# Presets.
PRESETS = {
    "default": DEFAULT, "high": replace(DEFAULT, threshold=0.45), "low": replace(DEFAULT, threshold=0.75),
    "strict": replace(DEFAULT, threshold=0.70, text={**TEXT_WEIGHTS, "doc_number": 0.22, "title": 0.18, "issue_date": 0.15}),
    "image": replace(DEFAULT, text_part=0.40, style_part=0.60, style={**STYLE_WEIGHTS, "has_red_header": 0.22, "has_seal_image": 0.18, "is_a4_paper": 0.12}),
}


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _sum(parts: list[Column]) -> Column:
    """From left to right, as floating sums depend on it."""
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def text_parts(w: Weights) -> dict[str, Column]:
    """What every fact adds, from the columns that features.facts() makes."""
    out = {}
    has = lambda f: F.col(f) != ""
    for name, weight in w.text.items():
        if name == "org":
            out[name] = F.when(F.size("org") > 3, F.lit(weight) * F.lit(1.2)).when(F.size("org") > 0, F.lit(weight)).otherwise(0.0)
        elif name == "prohibited":
            ratio = F.least(F.size("prohibited") / F.lit(5.0), F.lit(1.0))
            out[name] = F.when(F.size("prohibited") > 0, -(F.lit(weight) * ratio)).otherwise(0.0)
        elif name in ("doctype", "action", "formal", "header", "footer"):
            out[name] = F.when(F.size(name) > 0, F.lit(weight) * F.least(F.size(name), F.lit(3)).cast("double") / F.lit(3.0)).otherwise(0.0)
        elif name == "title_type":
            out[name] = F.when(has("title") & has("title_type"), F.lit(weight)).otherwise(0.0)
        else:
            out[name] = F.when(has(name), F.lit(weight)).otherwise(0.0)
    return out


def text_score(w: Weights = DEFAULT) -> Column:
    return _clamp(_sum(list(text_parts(w).values())))


def style_score(w: Weights = DEFAULT, style: str = "style") -> Column:
    """Layout score of a struct column of layout facts; 0 where it is null."""
    flag = lambda f: F.coalesce(F.col(f"{style}.{f}"), F.lit(False))
    return F.least(_sum([F.when(flag(f), F.lit(v)).otherwise(0.0) for f, v in w.style.items()]), F.lit(1.0))


def adjustments(style: str | None = None) -> dict[str, Column]:
    """Bonuses and penalties by name, in the order in which they are added."""
    has = lambda f: F.col(f) != ""
    n = F.col("text_length")
    give = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    out = {
        "short_text": F.when(n < 100, F.lit(-0.15)).when(n < 200, F.lit(-0.08)).otherwise(0.0),
        "core_facts": give(has("doc_number") & has("title") & has("issue_date"), 0.06),
        "copy_and_number": give(has("copy_number") & has("doc_number"), 0.03),
    }
    if style:
        s = lambda f: F.coalesce(F.col(f"{style}.{f}"), F.lit(False))
        red, seal, a4 = s("has_red_header"), s("has_seal_image"), s("is_a4_paper")
        image = F.coalesce(F.array_contains(F.col(f"{style}.style_reasons"), IMAGE_REASON), F.lit(False))
        out |= {
            "header_and_seal": give(red & seal, 0.08), "header_text_and_paper": give(red & s("has_red_text") & a4, 0.05),
            "image_layout": F.when(image & red & seal & a4, F.lit(0.15)).when(image & red & seal, F.lit(0.10)).when(image & red & a4, F.lit(0.06)).otherwise(0.0),
            "image_text": give(image & (n < 200) & (n >= 50), 0.05), "number_and_header": give(has("doc_number") & red, 0.05),
        }
    return out


def confidence_band(total: Column) -> Column:
    out = F.lit(LOWEST)
    for least, name in reversed(BANDS):
        out = F.when(total >= least, name).otherwise(out)
    return out


def scored(df: DataFrame, w: Weights = DEFAULT, style: str | None = None) -> DataFrame:
    """df (of features.facts()) with text_score, style_score, total_score, is_official, confidence, details.

    details maps every fact and adjustment that counts to what it adds.
    """
    shown = F.lit(False)
    if style:
        for f in STYLE_SHOWN:
            shown = shown | F.coalesce(F.col(f"{style}.{f}"), F.lit(False))
    more = adjustments(style)
    d = once(df, {
        "text_score": text_score(w), "style_score": style_score(w, style) if style else F.lit(0.0), "_shown": shown, **{f"_{k}": v for k, v in more.items()}
    })
    joined = F.col("text_score") * F.lit(w.text_part) + F.col("style_score") * F.lit(w.style_part)
    total = F.when(F.col("_shown"), joined).otherwise(F.col("text_score"))
    for k in more:
        total = total + F.col(f"_{k}")
    d = once(d, {"total_score": _clamp(total)})
    parts = {**text_parts(w), **{k: F.col(f"_{k}") for k in more}}
    details = F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]), lambda k, v: v != 0.0)
    d = d.withColumns({"is_official": F.col("total_score") >= w.threshold, "confidence": confidence_band(F.col("total_score")), "details": details})
    return d.drop("_shown", *[f"_{k}" for k in more])


def reasons(style: str | None = None) -> Column:
    """Why the verdict fell so, as an ordered list; the texts are fixed values."""
    has = lambda f: F.col(f) != ""
    s = (lambda f: F.coalesce(F.col(f"{style}.{f}"), F.lit(False))) if style else (lambda f: F.lit(False))
    yes = [
        (F.lit(True), F.lit("综合得分超过阈值，判定为公文")), (has("copy_number"), F.concat(F.lit("包含份号: "), "copy_number")),
        (has("doc_number"), F.lit("包含标准发文字号格式")), (has("title") & has("title_type"), F.concat(F.lit("包含公文标题格式("), "title_type", F.lit(")"))),
        (F.size("org") > 0, F.lit("包含党政机关名称")), (s("has_red_header"), F.lit("检测到红头版式")), (s("has_seal_image"), F.lit("检测到印章图片")),
        (s("is_a4_paper") & s("margin_match"), F.lit("页面设置符合公文规范")),
    ]
    no = [
        (F.lit(True), F.lit("综合得分未达到阈值，判定为非公文")), (~has("doc_number"), F.lit("缺少发文字号")), (~has("title"), F.lit("缺少公文标题格式")),
        (~has("issue_date"), F.lit("缺少成文日期")), (~s("has_red_header") & ~s("has_red_text"), F.lit("未检测到红色版式元素")),
        (F.size("prohibited") > 0, F.lit("包含非公文特征内容")),
    ]
    listed = lambda rs: F.array_compact(F.array(*[F.when(c, t) for c, t in rs]))
    return F.when(F.col("is_official"), listed(yes)).otherwise(listed(no))
