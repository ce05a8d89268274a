"""Claims in free text: phrases of a vocabulary, what denies or doubts them, and conflicts.

A text falls into sentences, and each is read once for all phrases by an automaton, in
Arrow batches.  What stands near a phrase within its sentence decides whether it claims
its value, claims that there is none, or only tells of a prospect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import READ_LIMIT
from tidemark.operators.vocabulary import VOCABULARY, Automaton, Claim, Template, phrases

NONE = "none"
#: Characters within which a denial stands before a claim, or disuse after it, and a prospect on either side.
BEFORE, AFTER, AROUND = 12, 24, 60

#: Words that deny what follows them.
DENIALS = ("cannot", "lack", "lacking", "lacks", "minus", "neither", "never", "no", "nor", "not", "without")
#: What is said after a thing that no longer serves.
DISUSE = (
    "abandoned", "capped", "dead", "decommissioned", "disconnected", "does not work", "doesn't work", "dry", "failed", "inoperable", "no longer",
    "non functional", "non-functional", "nonfunctional", "not working", "out of order", "out of service", "removed", "shut off", "torn out", "unusable",
)
#: What makes a claim a prospect, by kind: wants, offers, conditions, plans, places on the way, and room for a thing.
PROSPECTS = {
    "want": ("need", "needed", "needs", "required to", "requires"),
    "offer": ("availability", "available", "close by", "nearby"),
    "condition": ("can be", "could", "may be", "might", "must be", "will be", "would"),
    "plan": ("coming", "future", "planned", "proposed", "someday", "yet"),
    "place": ("approximately", "at the road", "at the street", "extending", "extends", "in the road", "in the street", "to the lot line", "to the property line"),
    "room": tuple(f"{x} for" for x in ("plumbed", "plumbing", "roughed in", "space", "spot", "stubbed in", "stubbed out", "vent", "venting", "wired", "wiring")),
}

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _terms(*words: str, more: str = "") -> re.Pattern[str]:
    """Finds whole-word terms wherever they begin, overlapping ones too."""
    return re.compile(r"(?<!\w)(?=((?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + more + r")(?!\w)))")


_DENIAL, _DISUSE = _terms(*DENIALS), _terms(*DISUSE)
#: A distance to it, and what is still to be done, are prospects too.
_PROSPECT = _terms(*(w for words in PROSPECTS.values() for w in words), more=r"|\d+ ?(?:ft|feet|mile|miles)|to be \w+ed")


def _spans(pattern: re.Pattern[str], sentence: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in pattern.finditer(sentence)]


def verdict(sentence: str, claim: Claim) -> str | None:
    """The value that a claim makes in its sentence, `none` if it is denied, nothing if it is denied to be none or a prospect."""
    near = sentence[max(0, claim.start - BEFORE - 20) : claim.start]
    denied = any(len(near) - end <= BEFORE and not re.search("[.;,]", near[end:]) for _, end in _spans(_DENIAL, near))
    after = sentence[claim.end : claim.end + AFTER + 30]
    denied = denied or any(start <= AFTER and not re.search("[.;]", after[:start]) for start, _ in _spans(_DISUSE, after))
    if denied:
        return None if claim.value == NONE else NONE
    if claim.value == NONE:
        return NONE
    low, high = max(0, claim.start - AROUND), claim.end + AROUND
    hoped = any(low <= start + low0 and end + low0 <= high for low0 in (max(0, low - 1),) for start, end in _spans(_PROSPECT, sentence[low0 : high + 1]))
    return None if hoped else claim.value


def read(text: str | None, automaton: Automaton, limit: int | None = READ_LIMIT) -> Iterator[tuple[str, str, str, str]]:
    """(field, value, phrase, evidence) of each claim of one text, in lower case and single blanks."""
    bounded = (text or "").strip()
    for part in _SENTENCE_END.split(bounded[:limit] if limit else bounded):
        sentence = " ".join(part.lower().split())
        for claim in automaton.claims(sentence):
            value = verdict(sentence, claim)
            if value is not None:
                yield claim.field, value, sentence[claim.start : claim.end], sentence


def found(texts: DataFrame, vocabulary: Mapping[str, Mapping[str, tuple[Template, ...]]] = VOCABULARY, limit: int | None = READ_LIMIT) -> DataFrame:
    """(id, field, value, phrase, evidence): one row for each claim, in no order, with its phrase and its sentence on one line, in lower case.

    Of overlapping phrases of a field the one that begins first counts, then the longest.
    A denied claim claims `none`; a denied `none` nothing.  A prospect within 60
    characters of its sentence makes a claim nothing, unless it claims `none`.  Reads the
    first `limit` characters, as descriptions are read, or whole texts for None.  A null
    or empty text claims nothing; repeated rows claim again.
    """
    known = texts.sparkSession.sparkContext.broadcast(phrases(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(known.value)
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1)):
                for claim in read(text.as_py(), automaton, limit):
                    rows.append(i)
                    out.append(claim)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.string()) for c in columns)], ["id", "field", "value", "phrase", "evidence"])

    fields = [texts.schema["id"], *(T.StructField(c, T.StringType()) for c in ("field", "value", "phrase", "evidence"))]
    return texts.select("id", "text").mapInArrow(work, T.StructType(fields))


def claims(texts: DataFrame, vocabulary: Mapping[str, Mapping[str, tuple[Template, ...]]] = VOCABULARY, limit: int | None = READ_LIMIT) -> DataFrame:
    """(id, field, value, conflict): one row for each field that a text makes a claim on (see `found`); two values are a conflict and no value."""
    n = F.size(F.collect_set("value"))
    return found(texts, vocabulary, limit).groupBy("id", "field").agg(F.when(n == 1, F.first("value")).alias("value"), (n > 1).alias("conflict"))


def accept(answers: DataFrame) -> DataFrame:
    """Adds whether a model's answer counts: a known value, its quote in the text word for word, and `none` only with a denial.

    answers: (text, value, quote, options array<string>).
    """
    folded = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    known = F.array_contains("options", F.col("value"))
    quoted = (folded(F.col("quote")) != "") & folded(F.col("text")).contains(folded(F.col("quote")))
    denied = (F.col("value") != "none") | folded(F.col("quote")).rlike(r"\b(no|not|none|without|never)\b")
    return answers.withColumn("accepted", F.coalesce(known & quoted & denied, F.lit(False)))


def settle(rows: DataFrame) -> DataFrame:
    """(value, origin) by precedence: the source's, the pattern's (a conflict settles it as none), the model's.

    rows: (source_value, pattern_value, conflict, model_value).
    """
    origin = F.when(F.col("source_value").isNotNull(), "source").when(F.col("conflict"), "conflict").when(F.col("pattern_value").isNotNull(), "pattern").when(F.col("model_value").isNotNull(), "model").otherwise("undetermined")
    value = F.when(origin == "source", F.col("source_value")).when(origin == "pattern", F.col("pattern_value")).when(origin == "model", F.col("model_value"))
    return rows.withColumn("value", value).withColumn("origin", origin)
