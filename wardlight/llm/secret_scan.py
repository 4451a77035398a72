"""Secrets in texts: fixed patterns, and strings that compression finds new.

The patterns give the base spans. Beyond them, a long string that follows a
sensitive word is a candidate. It is compressed together with what surrounds it
by a compressor primed with a dictionary of identifiers; the bytes that it adds
to its surroundings alone, per character, are its novelty. Names and paths cost
little; random strings cost nearly their entropy. Other copies of a string are
blanked out of its surroundings, and every copy of a new string is reported.
Strings that points join, like the parts of a web token, are one candidate.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.blocks import byte_class, pieces, tidy, words_of

# The base kinds in the order of the digest, with the fewest characters that count.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

# A candidate: a run of at least so many characters, so near after a sensitive word, and long runs that points join to it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?:\.[A-Za-z0-9+/_=-]{16,})*")
LEAST_RUN = 20
RUN = byte_class(r"[A-Za-z0-9+/_=-]") & (np.arange(256) < 128)
SENSITIVE = re.compile(r"(?ai)(?:key|auth|bearer|credential|private|pass|pwd|secret|token|signature|session)")
REACH = 40
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
# Characters before and after a candidate that it is measured against.
AROUND = 512
# Compressed bytes added per character, above which a candidate is reported. Random
# base64 text carries 0.75, hexadecimal digits 0.5, words of the dictionary well under 0.3.
NOVEL = 0.45

# Identifiers and words that the compressor knows beforehand.
IDENTIFIERS = """
private public static final class function return import export const let var def self this null true false
string integer boolean float double value values index count length size name names path file files folder
user username email address account session request response header headers content type application json
authorization bearer basic credential credentials signature certificate public_key private_key client_id
client_secret access_key secret_key session_token refresh_token api_key api_token password passwd secret token
config configuration environment variable development production staging example sample placeholder changeme
your_api_key_here your-secret-key-here insert_token_here xxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000
http https localhost www com org net html index default local server service database connection postgres mysql
the and for with that from this have which would there their about other into more some than them these only
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 documentation implementation initialization
""".split()

Span = tuple[int, int, int]  # start, end, kind


class Text:
    """One text: its bytes, decoded only if something in them calls for it."""

    def __init__(self, raw: bytes, long_run: bool):
        lower = raw.lower() if b":" in raw or b"=" in raw else b""
        self.assigns = any(k in lower for k in KEYWORDS)
        self.long_run = long_run
        self.keyed = b"AKIA" in raw
        self.text = raw.decode() if self.assigns or self.keyed or long_run else ""
        self.runs = list(CANDIDATE.finditer(self.text)) if long_run else []


def base_spans(text: Text) -> list[Span]:
    """Spans of the base patterns, by start, then kind; a match that is too short is dropped, not shortened.

    Every hexadecimal run that counts lies within one candidate run.
    """
    found = []
    if text.assigns:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text.text) if len(m[2]) >= LEAST_ASSIGN]
    if text.keyed:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text.text) if m.end() - m.start() >= LEAST_ACCESS]
    for run in text.runs:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text.text, run.start(), run.end())]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Novelty:
    """Compressed size that a string adds to its surroundings."""

    def __init__(self):
        primed = zstandard.ZstdCompressionDict(
            " ".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(
            level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def measure(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes per byte of text[start:end], without what other copies of its value save."""
        value = value_of(text[start:end])
        reach, blank = AROUND + len(value), "\n" * len(value)
        before = text[max(0, start - reach):start].replace(value, blank)[-AROUND:]
        after = text[end:end + reach].replace(value, blank)[:AROUND]
        own, around = text[start:end].encode(), f"{before}\n{after}\n".encode()
        added = len(self.compressor.compress(around + own)) - len(self.compressor.compress(around))
        return added / len(own)

    def spans(self, text: Text) -> list[Span]:
        """Candidates in a sensitive context with a part that does not compress, and all other places of such parts."""
        new: dict[str, bool] = {}
        found = []

        def told(at: int) -> bool:
            return SENSITIVE.search(text.text, max(0, at - REACH), at) is not None

        for m in text.runs:
            near, start, hit = told(m.start()), m.start(), False
            for part in m[0].split("."):
                end = start + len(part)
                if near or told(start):
                    value = value_of(part)
                    if not new.get(value):
                        new[value] = self.measure(text.text, start, end) >= NOVEL
                    hit |= new[value]
                start = end + 1
            if hit:
                found.append((m.start(), m.end(), 3))
        held = Cover(found)
        found += [s for s in places([v for v, is_new in new.items() if is_new], text.text) if not held.holds(s)]
        return sorted(set(found))


def places(values: list[str], text: str) -> Iterator[Span]:
    """All places of all values in a text, those of one value not overlapping, in one pass."""
    if not values:
        return
    tree = ahocorasick.Automaton()
    for value in values:
        tree.add_word(value, value)
    tree.make_automaton()
    free: dict[str, int] = {}
    for last, value in tree.iter(text):
        start = last + 1 - len(value)
        if start >= free.get(value, 0):
            free[value] = last + 1
            yield start, last + 1, 3


def value_of(run: str) -> str:
    """What stands after the last inner equals sign of a run, if it is long enough to be a candidate; else the run."""
    value = run.rstrip("=").rpartition("=")[2]
    return value if len(value) >= LEAST_RUN else run


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


class Cover:
    """Intervals, of which one may hold a given one."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.ends = list(accumulate((e for _, e, _ in spans), max))

    def holds(self, span: Span) -> bool:
        at = bisect.bisect_right(self.starts, span[0])
        return at > 0 and self.ends[at - 1] >= span[1]


def all_spans(text: Text, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added ones together. An added span that a base span covers is left out."""
    base = base_spans(text)
    added = novelty.spans(text)
    if added:
        held = Cover(base)
        added = [s for s in added if not held.holds(s)]
    return base, sorted(base + added, key=lambda s: (s[0], s[2])) if added else base


def texts_of(column: pa.Array) -> Iterator[Text]:
    """The texts of a column of bytes; runs that are long enough to matter are found for many texts at once."""
    for begin, stop, data, edges in pieces(column):
        runs = words_of(data, edges, RUN)
        long = np.searchsorted(edges, runs.start[runs.end - runs.start >= LEAST_RUN], side="right") - 1
        with_run = np.bincount(long, minlength=stop - begin) > 0
        whole = data.tobytes()
        for i in range(stop - begin):
            yield Text(whole[edges[i]:edges[i + 1]], bool(with_run[i]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) for every row.

    Offsets are code points. A null text counts as an empty one: no spans and
    the hash of the empty string. Repeated rows give equal results, an empty
    table an empty one; other columns are not read. A very long text is scanned
    whole, in time that grows with its length.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in texts_of(batch.column(1)):
                base, whole = all_spans(text, novelty)
                counts.append(np.bincount([s[2] for s in whole], minlength=4) if whole else np.zeros(4, np.int64))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(whole))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(n[:, k]) for k in range(3)], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(n[:, 3])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(tidy(run), schema)


MASK = "[SECRET]"


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced; overlapping spans are replaced once."""
    out, at = [], 0
    for start, end, _ in spans:
        if end > at:
            out += [text[at:start], MASK] if start >= at else []
            at = end
    return "".join([*out, text[at:]]) if out else text


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked in the text; a null text stays null.

    Ids are not looked at: rows that repeat are masked alike. A very long text
    is masked whole. An empty table gives an empty result.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            field, texts = batch.schema.field(place), batch.column(place)
            changed = []
            for cell, text in zip(texts, texts_of(texts.cast(pa.binary()))):
                spans = all_spans(text, novelty)[1] if text.text else []
                changed.append(masked(text.text, spans) if spans else cell.as_py())
            yield batch.set_column(place, field, pa.array(changed, field.type))

    return docs.mapInArrow(tidy(run), docs.schema)
