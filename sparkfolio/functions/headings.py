"""Heading classes of a paper: ordered patterns, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkfolio.functions.text import squeeze

# Wording that decides what a heading introduces.
ABSTRACT = r"(?U)\b(?:abstract|tóm tắt)\b"
REFERENCES = r"(?U)\b(?:references?|bibliography|tài liệu tham khảo)\b"
LIMITATIONS = r"(?U)\b(?:limitations?|future work|giới hạn)\b"
DISCUSSION = r"(?U)\bdiscussions?\b"
NEUTRAL = (
    r"(?U)\b(?:introduction|related works?|prior work|conclusions?|acknowledge?ments?|"
    r"acknowledgments?|broader impacts?|ethics?|ethical|reproducibility statement|"
    r"author contributions?|funding|giới thiệu|kết luận)\b"
)
SETUP = (
    r"(?U)\b(?:set-?ups?|hyper-?parameters?|hardware|computing|compute|computational (?:resources?|cost|budget)|"
    r"configurations?|protocols?|"
    r"(?:experimental|experiments?|implementation|training|evaluation|optimi[sz]ation|dataset|"
    r"model|network|architecture|task)\s+(?:details?|settings?|procedures?|recipes?)|"
    r"details? of (?:the )?(?:experiments?|implementation|training))\b"
)
IMPLEMENTATION = r"(?U)\bimplementations?\b"
EXPERIMENTS = (
    r"(?U)\b(?:experiments?|experimental|evaluations?|benchmarks?|results?|ablations?|empirical|"
    r"findings|thực nghiệm|kết quả)\b"
)
METHOD = (
    r"(?U)\b(?:methods?|methodology|approach(?:es)?|architectures?|models?|framework|proposed|system|"
    r"formulation|algorithms?|design|background|preliminar\w*|problem|phương pháp)\b"
)
DETAILS = r"(?U)\bdetails?\b"
NOT_DETAILS = r"(?U)\b(?:proofs?|derivations?|theor\w+|lemmas?)\b"
HARDWARE = (
    r"\b(?:GPUs?|TPUs?(?:\s?v\d+)?|TPUv\d+|CPUs?|A100s?|V100s?|H100s?|H200s?|A6000|RTX\s?\d{3,4}|GTX\s?\d{3,4}|"
    r"NVIDIA|Nvidia|TFLOPs?|GPU[- ]hours?|(?:\d+\s?)?GB\s+(?:of\s+)?(?:memory|RAM|VRAM))\b"
)
UNNAMED = "unnamed"


def _folded(title: Column) -> Column:
    return squeeze(F.lower(F.coalesce(title, F.lit(""))))


def heading_class(title: Column, appendix: Column) -> Column:
    """Class of a top heading; ``unnamed`` marks the paper's own headings, ``none`` neutral ones."""
    t = _folded(title)
    extra = F.when(t.rlike(DETAILS) & ~t.rlike(NOT_DETAILS), "setup").otherwise("none")
    return (F.when(t == "", "none").when(t.rlike(ABSTRACT), "abstract").when(t.rlike(REFERENCES), "references")
            .when(t.rlike(LIMITATIONS), "limitations").when(t.rlike(SETUP), "setup").when(t.rlike(EXPERIMENTS), "experiments")
            .when(t.rlike(IMPLEMENTATION), "setup").when(t.rlike(DISCUSSION), "limitations").when(t.rlike(NEUTRAL), "none")
            .when(t.rlike(METHOD), "methodology").when(appendix, extra).otherwise(UNNAMED))


def classify_top(title: Column, appendix: Column, seen_experiments: Column) -> Column:
    """Section of a top heading, NULL for neutral material."""
    kind = heading_class(title, appendix)
    own = F.when(seen_experiments, "experiments").otherwise("methodology")
    return F.when(kind == UNNAMED, own).when(kind != "none", kind)


def classify_sub(title: Column) -> Column:
    """Override of a sub-heading: ``setup``, ``limitations`` or NULL."""
    t = _folded(title)
    return (F.when(t.rlike(LIMITATIONS), "limitations")
            .when(t.rlike(SETUP) | (t.rlike(IMPLEMENTATION) & ~t.rlike(EXPERIMENTS)), "setup"))
