"""Layout predicates: colours, paper, margins, fonts, seals, and unreadable text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page and paragraph standards in mm and pt, and font sizes by name.
A4 = (210.0, 297.0)
MARGINS = {"top": 37.0, "bottom": 35.0, "left": 28.0, "right": 26.0}
MARGIN_TOLERANCE = 2.0
LINE_SPACING, TITLE_SIZE, BODY_SIZE = 28.0, 22.0, 16.0
FONT_SIZES = {"小五": 9.0, "五号": 10.5, "小四": 12.0, "四号": 14.0, "小三": 15.0, "三号": 16.0, "小二": 18.0, "二号": 22.0, "小一": 24.0, "一号": 26.0}
TWIPS_PER_PT, MM_PER_PT = 20.0, 25.4 / 72
# Words of red headers and of seals.
RED_HEADER_WORDS = ("文件", "通知", "通报", "决定", "命令", "公告", "意见", "报告", "请示", "批复", "函", "发〔", "发[", "发（", "字〔", "字[")
SEAL_WORDS = ("印章", "盖章", "公章", "专用章", "合同章", "人民政府", "委员会", "办公室", "局", "厅", "有限公司", "股份公司")


def rgb(color: Column) -> tuple[Column, Column, Column]:
    """Components of RRGGBB with or without #."""
    c = F.upper(F.regexp_replace(color, "^#", ""))
    return tuple(F.conv(F.substring(c, k, 2), 16, 10).cast("int") for k in (1, 3, 5))


def is_red(color: Column, least: int = 180, most: int = 80) -> Column:
    """A colour of 6 hexadecimal digits with high red and low green and blue, or named red."""
    r, g, b = rgb(color)
    hexa = F.regexp_replace(color, "^#", "")
    return (F.lower(hexa) == "red") | (hexa.rlike(r"^[0-9A-Fa-f]{6}\z") & (r >= least) & (g <= most) & (b <= most))


def near(value: Column, standard: float, tolerance: float) -> Column:
    return value.between(F.lit(standard - tolerance), F.lit(standard + tolerance))


def is_a4(width_mm: Column, height_mm: Column, tolerance: float = 2.0) -> Column:
    return near(width_mm, A4[0], tolerance) & near(height_mm, A4[1], tolerance)


def margins_fit(top: Column, bottom: Column, left: Column, right: Column) -> Column:
    fits = [near(c, MARGINS[k], MARGIN_TOLERANCE) for k, c in (("top", top), ("bottom", bottom), ("left", left), ("right", right))]
    return fits[0] & fits[1] & fits[2] & fits[3]


def font_size_name(pt: Column) -> Column:
    """The name of a font size within half a point; the smaller of two; '' if none."""
    out = F.lit("")
    for name, size in sorted(FONT_SIZES.items(), key=lambda x: -x[1]):
        out = F.when(near(pt, size, 0.5), name).otherwise(out)
    return out


def twips_to_pt(twips: Column) -> Column:
    return twips / F.lit(TWIPS_PER_PT)


def twips_to_mm(twips: Column) -> Column:
    return twips / F.lit(TWIPS_PER_PT) * F.lit(MM_PER_PT)


def red_header_hint(text: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in RED_HEADER_WORDS]), lambda w: F.contains(text, w))


def seal_hint(text: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in SEAL_WORDS]), lambda w: F.contains(text, w))


def _share(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return 0.0
    dense = int(codes.max()) < 4 * len(codes) + 4096  # else a few high characters in a short text: sorting is less than a table
    return int((np.bincount(codes) if dense else np.unique(codes, return_counts=True)[1]).max()) / len(codes)


def top_share(text: Column) -> Column:
    """The part of a text that its most frequent character makes up; 0 for an empty text, null for null.

    One pass over the code points of each row, counted by numpy: no row is exploded or shuffled, and the
    work does not grow with the number of different characters.
    """

    @F.pandas_udf("double")
    def share(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _share(x) for x in t], dtype="float64")

    return share(text)


def is_garbage(df: DataFrame, id_col: str, text: str, part: float = 0.6) -> DataFrame:
    """(id_col, top_share, is_garbage): whether one character makes up more than part of a text.

    A row for every row; an empty text is not garbage, a null text has nulls.
    """
    share = df.select(id_col, top_share(F.col(text)).alias("top_share"))
    return share.withColumn("is_garbage", F.col("top_share") > part)


def readability(text: Column) -> Column:
    """The part of letters, digits, common punctuation and white space; 0 for an empty text."""
    n = F.length(text)
    readable = F.regexp_count(text, F.lit(r"[A-Za-z0-9 \t\n\r.,;:!?'\"()\-\x{4E00}-\x{9FFF}，。；：！？（）]"))
    return F.when(n == 0, 0.0).otherwise(readable / n)
