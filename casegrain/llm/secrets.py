"""Secrets in texts: fixed patterns, and formats learned from the credentials that the patterns label.

Grammar inference: the labelled values of a kind form a prefix tree of character classes; states whose outgoing frequencies
are statistically compatible are merged, which turns the tree into a probabilistic automaton. Every other long token is then
scored by how much likelier a kind's automaton makes it than the automaton of ordinary tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from casegrain.llm.common import code_points, query, released, table, text_batches, with_columns
from casegrain.session import stored

# The kinds and their patterns.
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORD = re.compile(r"[A-Za-z]+")
DIGIT = re.compile(r"[0-9]")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Labelled values per kind that an automaton is learned from, at most, chosen by a hash of the value; longer ones are left out.
FIT_VALUES, FIT_LENGTH = 600, 128
#: Tokens that are scored: this long. Those with a digit are what numbers are learned from.
LEAST_TOKEN = 16
#: Natural log of how much likelier a credential's format must be than an ordinary token's.
LEAST_GAIN = 12.0
#: Ordinary tokens have two automata, of words and of tokens with a digit; the likelier one counts.
ORDINARY = ("word", "number")

_TOKEN = np.zeros(128, dtype=bool)
_TOKEN[[c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-"]] = True
_HEX = np.zeros(128, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def symbols(value: str) -> str:
    """Character classes: 0 digit, a and A letters up to f, g and G other ASCII letters, any other character itself."""
    return "".join("0" if c in "0123456789" else "a" if "a" <= c <= "f" else "A" if "A" <= c <= "F"
                   else "g" if "a" <= c <= "z" else "G" if "A" <= c <= "Z" else c for c in value)


@dataclass
class Automaton:
    """States with counts of outgoing symbols (END: the value ends here) and their followers.

    ``usual`` is the range of the log-likelihood per symbol, without the end, that its values have.
    """

    counts: list[dict[str, float]] = field(default_factory=list)
    follow: list[dict[str, int]] = field(default_factory=list)
    usual: tuple[float, float] = (0.0, 0.0)

    END = ""
    RARE = 1e-3

    def log_likelihood(self, value: str, end: bool = True) -> float:
        """Natural log of the value's probability; what was never seen in a state has a small share, and then all symbols."""
        total, state = 0.0, 0
        for s in [*symbols(value), *[self.END] * end]:
            if state is None:
                total += math.log(self.RARE)
                continue
            here = self.counts[state]
            n = sum(here.values())
            total += math.log((here.get(s, 0.0) + self.RARE) / (n + self.RARE * 64)) if n else math.log(self.RARE)
            state = self.follow[state].get(s) if s else state
        return total


def learn(values: Sequence[str], confidence: float = 0.05) -> Automaton:
    """State merging on the prefix tree of ``values``: red states stay, a blue follower is merged into the first red state
    that it is compatible with (Hoeffding bounds on all frequencies, and on those below), else it turns red."""
    counts: list[dict[str, float]] = [{}]
    follow: list[dict[str, int]] = [{}]
    for value in values:
        state = 0
        for s in symbols(value):
            counts[state][s] = counts[state].get(s, 0) + 1
            if s not in follow[state]:
                follow[state][s] = len(counts)
                counts.append({})
                follow.append({})
            state = follow[state][s]
        counts[state][Automaton.END] = counts[state].get(Automaton.END, 0) + 1
    bound = math.sqrt(0.5 * math.log(2 / confidence))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = sum(counts[a].values()), sum(counts[b].values())
            if n and m:
                most = bound * (n ** -0.5 + m ** -0.5)
                if any(abs(counts[a].get(s, 0) / n - counts[b].get(s, 0) / m) > most for s in counts[a].keys() | counts[b].keys()):
                    return False
            stack += [(follow[a][s], follow[b][s]) for s in follow[a].keys() & follow[b].keys() if follow[a][s] != follow[b][s]]
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below ``b`` to the state ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            for s, n in counts[b].items():
                counts[a][s] = counts[a].get(s, 0) + n
            for s, child in follow[b].items():
                if s in follow[a]:
                    stack.append((follow[a][s], child))
                else:
                    follow[a][s] = child

    red, place = [0], {0}
    while True:
        blue = [(r, s, t) for r in red for s, t in sorted(follow[r].items()) if t not in place]
        if not blue:
            break
        parent, s, state = max(blue, key=lambda x: sum(counts[x[2]].values()))
        for r in red:
            if compatible(r, state):
                follow[parent][s] = r
                fold(r, state)
                break
        else:
            red.append(state)
            place.add(state)
    number = {state: i for i, state in enumerate(red)}
    out = Automaton([counts[r] for r in red], [{s: number[t] for s, t in follow[r].items()} for r in red])
    if values:
        means = sorted(out.log_likelihood(v, end=False) / len(v) for v in values if v)
        out.usual = (means[len(means) // 100] - 0.3, means[-1 - len(means) // 100] + 0.03)
    return out


def runs(texts: Sequence[str]) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Per text the (start, end) of its long lower-case hexadecimal runs and of its long tokens."""
    points, offsets = code_points([t + "\n" for t in texts])
    low = np.minimum(points, 127)
    low = np.where(points > 126, 10, low)
    out = []
    for kind, least in ((_HEX, LEAST_HEX), (_TOKEN, LEAST_TOKEN)):
        edge = np.flatnonzero(np.diff(kind[low], prepend=False))
        start, end = edge[0::2], edge[1::2]
        long = end - start >= least
        start, end = start[long], end[long]
        doc = np.searchsorted(offsets, start, side="right") - 1
        lists: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, a, b in zip(doc.tolist(), (start - offsets[doc]).tolist(), (end - offsets[doc]).tolist()):
            lists[d].append((a, b))
        out.append(lists)
    return out[0], out[1]


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the patterns' matches, by start and then kind."""
    found = [(a, b, "hex", text[a:b]) for a, b in hexes]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def free(tokens: list[tuple[int, int]], taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in tokens if not any(a < y and x < b for x, y, *_ in taken)]


def train(docs: DataFrame, fit_values: int = FIT_VALUES) -> dict[str, Automaton]:
    """An automaton per kind, and those of ordinary tokens, from the labelled values of ``docs`` (text).

    At most ``fit_values`` distinct values of at most ``FIT_LENGTH`` characters of each reach the driver, those with the
    smallest hash of the value.
    """
    def labelled(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            kinds, values = [], []
            for text, hexes, tokens in zip(texts, *runs(texts)):
                base = base_spans(text, hexes)
                kinds += [f[2] for f in base]
                values += [f[3] for f in base]
                numbers = [text[a:b] for a, b in free(tokens, base) if DIGIT.search(text, a, b)]
                kinds += [*["number"] * len(numbers), "word"]
                values += [*numbers, max(WORD.findall(text), key=len, default="none")]
            kept = [i for i, v in enumerate(values) if len(v) <= FIT_LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in kept], type=pa.string()),
                                              pa.array([values[i] for i in kept], type=pa.string())], names=["kind", "value"])

    found = stored(docs.select("text").mapInArrow(released(labelled), "kind string, value string").distinct(), "labelled-values")
    found = found.withColumn("pick", F.xxhash64("value"))
    picked = None
    for kind in (*KINDS, *ORDINARY):
        part = found.where(F.col("kind") == kind).orderBy("pick", "value").limit(fit_values)
        picked = part if picked is None else picked.unionByName(part)
    values: dict[str, list[str]] = {k: [] for k in (*KINDS, *ORDINARY)}
    for r in picked.collect():
        values[r["kind"]].append(r["value"])
    return {k: learn(sorted(v)) for k, v in values.items()}


def format_kind(value: str, automata: dict[str, Automaton], least_gain: float = LEAST_GAIN) -> str | None:
    """The kind whose format a token has, or None for an ordinary token."""
    usual = max(automata[k].log_likelihood(value) for k in ORDINARY)
    best, kind = least_gain, None
    for k in KINDS:
        if automata[k].counts[0]:
            fit, (low, high) = automata[k].log_likelihood(value), automata[k].usual
            if low <= automata[k].log_likelihood(value, end=False) / len(value) <= high and fit - usual >= best:
                best, kind = fit - usual, k
    return kind


def scan(docs: DataFrame, automata: dict[str, Automaton], least_gain: float = LEAST_GAIN) -> DataFrame:
    """All columns of ``docs`` with ``secrets``, an array of (start, end, kind, base) in code points, by start.

    Base matches always stay; a token that overlaps none and that has a learned format is added as ``like_<kind>``. A null
    text has none. Whole texts are searched. A column ``secrets`` of ``docs`` is replaced.
    """
    docs = docs.drop("secrets")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                     T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def find(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            out = []
            for text, hexes, tokens in zip(texts, *runs(texts)):
                base = base_spans(text, hexes)
                spans = [{"start": a, "end": b, "kind": k, "base": True} for a, b, k, _ in base]
                for a, b in free(tokens, base):
                    if kind := format_kind(text[a:b], automata, least_gain):
                        spans.append({"start": a, "end": b, "kind": f"like_{kind}", "base": False})
                out.append(sorted(spans, key=lambda s: s["start"]))
            yield with_columns(batch, batch.schema.names, {"secrets": pa.array(out, type=arrow)})

    return docs.mapInArrow(released(find), T.StructType([*docs.schema.fields, T.StructField("secrets", span)]))


def redacted(scanned: DataFrame) -> DataFrame:
    """The documents of `scan` with every span (overlapping ones as one) replaced by its kind in brackets."""
    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "secrets"))
            out = []
            for text, spans in zip(texts, lists):
                parts, at = [], 0
                for s in spans or ():
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]) if parts else text)
            columns = [pa.array(out, type=pa.string()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).drop_columns(["secrets"])

    return scanned.mapInArrow(released(cut), T.StructType([f for f in scanned.schema.fields if f.name != "secrets"]))


@query("op5_secret_formats")
def op5_secret_formats(spark, sf_dir):
    """Every document with counts and a digest of its base matches, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs)).select("doc_id", "secrets")
    listed = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter("secrets", lambda s: s["base"])
    digest = F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","), 256)

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), digest.alias("base_sha256"), F.array_join(listed, ",").alias("spans"))
