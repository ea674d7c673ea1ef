"""Page sections and scores of image candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which a page's section is told, in order, and the length of the text looked at.
SECTION_WORDS = [
    ("abstract", r"\b(abstract)\b"),
    ("introduction", r"\b(introduction)\b"),
    ("related", r"\b(related work|background|prior work)\b"),
    ("method", r"\b(method|methodology|approach|model|architecture)\b"),
    ("results", r"\b(experiment|evaluation|result)\b"),
]
PAGE_HEAD = 2000
# What an image's section adds.
SECTION_SCORES = {"method": 25, "results": 15, "introduction": 5}


def page_section(text: Column) -> Column:
    head, out = F.lower(F.substring(text, 1, PAGE_HEAD)), F.when(F.lit(False), "")
    for name, words in SECTION_WORDS:
        out = out.when(head.rlike(words), name)
    return out.otherwise("unknown")


def image_score(width: Column, height: Column, caption_score: Column, section: Column, page: Column) -> Column:
    """Score of an image candidate; null caption_score means no caption. Icons score 0."""
    area, ratio = width * height, F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    size = F.when(area > 500000, -20).when((area > 50000) & (area < 300000), 10).otherwise(0)
    form = F.when(ratio > 5, -15).when(ratio > 3, -5).otherwise(5)
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SECTION_SCORES.items() for x in kv)), section), F.lit(0))
    total = size + form + F.coalesce(caption_score + 20, F.lit(0)) + place + F.when(page <= 2, 5).otherwise(0)
    return F.when(area < 15000, 0).otherwise(total).cast("double")
