"""Column functions on texts: similarity, scores, truncation, extraction, dates."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def words(text: Column) -> Column:
    """Lower-case words, split at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of words; 1 for equal texts, 0 if one is empty."""

    def of(sets: Column) -> Column:
        common = F.size(F.array_intersect(sets["a"], sets["b"]))
        union = F.size(sets["a"]) + F.size(sets["b"]) - common
        return F.when((F.size(sets["a"]) == 0) | (F.size(sets["b"]) == 0), F.lit(0.0)).otherwise(common.cast("double") / union)

    sets = F.array(F.struct(F.array_distinct(words(a)).alias("a"), F.array_distinct(words(b)).alias("b")))  # a lambda holds each value once
    return F.when(a == b, F.lit(1.0)).otherwise(F.get(F.transform(sets, of), F.lit(0)))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence of two lists, of which None matches nothing.

    A bit for each place of the longer list tells whether the row of lengths stays the same there; each entry of the shorter one
    makes the next row by a sum, 64 places or more at a time.
    """
    short, long = sorted((a, b), key=len)
    places: dict = {}
    for i, x in enumerate(long):
        if x is not None:
            places.setdefault(x, []).append(i)
    bits = {}
    for x in {x for x in short if x in places}:
        held = np.zeros(len(long), dtype=np.uint8)
        held[places[x]] = 1
        bits[x] = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
    full = (1 << len(long)) - 1
    row = full
    for x in short:
        if met := row & bits.get(x, 0):
            row = (row + met | row - met) & full
    return len(long) - row.bit_count()


def lcs_similarity(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays over the longer length; 1 if both are empty, 0 if one is, null if one is null."""

    @pandas_udf("long")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")

    longer = F.greatest(F.size(a), F.size(b))
    found = length(a.cast("array<string>"), b.cast("array<string>"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(longer == 0, F.lit(1.0)).otherwise(found.cast("double") / longer)


def outputs_match(a: Column, b: Column) -> Column:
    """Equal after trimming and lower-casing; two nulls match."""
    return F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def effects_recall(expected: Column, found: Column) -> Column:
    """Share of expected effects that were found; 1 if none was expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise((F.size(wanted) - F.size(F.array_except(wanted, found))).cast("double") / F.size(wanted))


def scenario_score(sequence: Column, match: Column, recall: Column) -> Column:
    return F.round(sequence * 0.4 + match.cast("double") * 0.3 + recall * 0.3, 6)


def scenario_evaluation(calls: Column, traced: Column, output: Column, said: Column, effects: Column, seen: Column, has_trace: Column) -> Column:
    """A struct for one trace of a scenario: sequence, output_correct, effects, overall (0.4, 0.3 and 0.3 of them), missed_calls and
    missed_effects. Without a trace all scores are 0 and everything was missed."""
    sequence, match, recall = lcs_similarity(calls, traced), outputs_match(output, said), effects_recall(effects, seen)
    none = lambda score: F.when(has_trace, score).otherwise(F.lit(0.0))
    missed = lambda wanted, got: F.when(has_trace, F.filter(wanted, lambda w: ~F.array_contains(got, w))).otherwise(wanted)
    return F.struct(
        F.round(none(sequence), 6).alias("sequence"), (has_trace & match).alias("output_correct"), F.round(none(recall), 6).alias("effects"), none(scenario_score(sequence, match, recall)).alias("overall"),
        missed(calls, traced).alias("missed_calls"), missed(F.array_distinct(effects), seen).alias("missed_effects"))


# What each type of change does to a component.
CHANGES = {
    "signature": "Change {} signature: add required parameter 'options: dict'", "return_type": "Change {} return type from current to Optional[...]", "behavior": "Change {} to return None on error instead of raising exception",
    "removal": "Delete {} entirely", "rename": "Rename {} to {}_v2",
}


def impact_text(change: Column, component_id: Column) -> Column:
    """What a change of a type does to a component, by its short name; null for other types."""
    name = F.element_at(F.split(component_id, r"\."), -1)
    out = F.lit(None).cast("string")
    for kind, text in CHANGES.items():
        out = F.when(change == kind, F.replace(F.lit(text), F.lit("{}"), name)).otherwise(out)
    return out


def content_mismatch(summary_a: Column, summary_b: Column, description_a: Column, description_b: Column) -> Column:
    """An array of (kind, confidence) for a summary or a description that differs and is less similar than 0.90 or 0.85; the similarity is the confidence."""

    def of(kind: str, a: Column, b: Column, least: float) -> Column:
        return F.when(similarity_of(a, b) < least, F.struct(F.lit(kind).alias("kind"), F.round(similarity_of(a, b), 9).alias("confidence")))

    def similarity_of(a: Column, b: Column) -> Column:
        return jaccard(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))

    return F.array_compact(F.array(of("summary", summary_a, summary_b, 0.90), of("description", description_a, description_b, 0.85)))


def reconstruction_score(expected: Column, given: Column) -> Column:
    """1 if equal when trimmed, 0.7 if equal without case and runs of white space, else 0."""
    loose = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.when(given.isNull(), F.lit(0.0)).when(F.trim(expected) == F.trim(given), F.lit(1.0)).when(loose(expected) == loose(given), F.lit(0.7)).otherwise(F.lit(0.0))


def summary(text: Column) -> Column:
    """At most 200 characters: longer texts are cut at 197, or at the last space beyond 150, and end in '...'."""
    head = F.substring(text, 1, 197)
    space = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space - 1 > 150), F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.char_length(text) <= 200, text).otherwise(F.concat(cut, F.lit("...")))


# Fixed values in the four functions below: how a comment states its resolution, a ticket its id and a source its signature.
def resolution_action(comment: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(comment, r"(?is)RESOLUTION:\s*(accept_a|accept_b|merge|manual)\s*\n?(.*)", 1)), F.lit(""))


def resolution_content(comment: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(comment, r"(?is)RESOLUTION:\s*(?:accept_a|accept_b|merge|manual)\s*\n?(.*)", 1)), F.lit(""))


def ticket_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(bd-[a-z0-9]+)", 1), F.lit(""))


def signature(source: Column) -> Column:
    found = F.regexp_extract(source, r"(?m)^(def\s+\w+\s*\([^)]*\).*?:)", 1)
    return F.when(found == "", F.lit("def unknown():")).otherwise(found)


#: Patterns whose matches a challenge masks.
MASKS = {"constants": r"\b\d+\.?\d*\b", "strings": r"[\"'][^\"']*[\"']", "conditions": r"if\s+(?:.+?):", "returns": r"return\s+(?:.+?)(?:\n|$)", "function_calls": r"(?:\w+)\s*\(", "loop_bounds": r"(?:range|while)\s*\((?:[^)]+)\)"}


def mask_count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(MASKS[kind]))


def masked(text: Column, kind: str, percent: int) -> Column:
    """text with a deterministic share of a pattern's matches replaced; which ones follows from a hash of text and place."""
    parts = F.split(text, MASKS[kind])
    found = F.regexp_extract_all(text, F.lit(f"({MASKS[kind]})"), F.lit(1))
    kept = F.transform(found, lambda m, i: F.when(F.pmod(F.xxhash64(text, i), F.lit(100)) < percent, F.concat(F.lit("[MASK_"), i.cast("string"), F.lit("]"))).otherwise(m))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit("")))), "")


def mask_spans(text: str, kinds: tuple[str, ...], percent: int) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of the matches to mask, in order: a share that follows from a hash of text, kind and place; of those that overlap the earliest, then the longest."""
    found = [(m.start(), -m.end(), kind) for kind in kinds for m in re.finditer(MASKS[kind], text) if zlib.crc32(f"{kind}:{m.start()}:{text}".encode()) % 100 < percent]
    out: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted(found):
        if -end > begin and (not out or begin >= out[-1][1]):
            out.append((begin, -end, kind))
    return out


def masked_by_all(text: Column, kinds: tuple[str, ...] = ("constants", "conditions", "returns"), percent: int = 30) -> Column:
    """A struct of the text with matches of several patterns masked, the number of masks, and that number over the text's words."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans, out, at = mask_spans(t or "", kinds, percent), [], 0
            for i, (begin, end, _) in enumerate(spans):
                out += [t[at:begin], f"[MASK_{i}]"]
                at = end
            rows.append(("".join([*out, (t or "")[at:]]), len(spans), len(spans) / max(1, len((t or "").split()))))
        return pd.DataFrame(rows, columns=["masked", "masks", "mask_ratio"])

    return pandas_udf(run, "masked string, masks int, mask_ratio double")(text)


def iso_time(text: Column) -> Column:
    """A timestamp from ISO text, Z as +00:00, null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def still_valid(made: Column, now: Column, hours: Column) -> Column:
    """Whether a cache entry is within its time to live; 0 hours never end."""
    return (hours == 0) | (F.unix_micros(now) <= F.unix_micros(made) + hours.cast("long") * 3_600_000_000)
