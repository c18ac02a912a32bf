"""Text functions that need Python: exact HTML cleaning and pluggable scorers, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Elements whose strings are not text of a page.
SILENT = frozenset(("script", "style", "template", "rt", "rp"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def clean(html: str | None) -> str:
    """Text of a piece of markup, its pieces one space apart, white space collapsed; scripts, styles, templates and ruby notes are left out."""
    if not html:
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\s+", " ", " ".join(p.parts)).strip()


@F.pandas_udf(T.StringType())
def clean_text(html: pd.Series) -> pd.Series:
    return html.map(clean)


SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("positive", "negative", "neutral", "compound")] + [T.StructField("label", T.StringType())])
#: The labels that a scorer gives.
LABELS = ("positive", "negative", "neutral")

#: A scorer gives a list of texts one (positive, negative, neutral) each; a factory loads it, once a worker.
Scorer = Callable[[list[str]], list[tuple[float, float, float]]]


def scorer_udf(factory: Callable[[], Scorer], batch: int = 64):
    """A column function over texts. compound is positive minus negative; the label is that of the largest; an empty text is neutral."""

    @F.pandas_udf(SCORES)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list[tuple[float, float, float]] = []
            for i in range(0, len(texts), batch):
                out += scorer(texts[i : i + batch])
            rows = [(0.0, 0.0, 1.0) if not t.strip() else p for t, p in zip(texts, out, strict=True)]
            yield pd.DataFrame([(*p, p[0] - p[1], LABELS[max(range(3), key=lambda k: p[k])]) for p in rows], columns=[f.name for f in SCORES])

    return score


def lexicon_scorer(positive: frozenset[str], negative: frozenset[str]) -> Callable[[], Scorer]:
    """A scorer by counting words of two lists; it stands in where model weights are not at hand."""

    def factory() -> Scorer:
        def run(texts: list[str]) -> list[tuple[float, float, float]]:
            out = []
            for t in texts:
                words = re.findall(r"\w+", t.lower())
                p, n = sum(w in positive for w in words), sum(w in negative for w in words)
                total = p + n + 1
                out.append((p / total, n / total, 1 / total))
            return out

        return run

    return factory
