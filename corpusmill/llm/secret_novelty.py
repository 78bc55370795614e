"""Operator 7: secrets by fixed patterns and by dictionary-primed compression novelty.

Base spans come from three patterns. The method adds spans of kind ``novel``. Its candidates are all strings of 16 or more characters
that keys are made of, beginning within ``reach`` characters after a sensitive word, on its line or, where nothing but blanks, quotes
and assignment signs lies between, on a later one; and the body of every key block between its BEGIN and END lines, which is one candidate
from its first to its last line. Of each the marginal compressed size is measured, with the surrounding code and an identifier dictionary to copy from; where it stays close to the
candidate's length, nothing around or in the dictionary explains it. Short strings of unknown words hardly compress either, so
that novel ones spelled like words, by the pairs of letters in the dictionary, are told apart.
Words, identifiers, paths and anything repeated nearby are not reported; keys and random tokens are, also where a base span
covers them, for the base span holds the name with the value.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive, of the whole match; a novel span that
equals a base span is not told twice; spans that tie in start go by kind; a text of any length is scanned once; repeated rows and
null ids are scanned each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive.
CONTEXT = re.compile(r"(?:secret|token|passw|pwd|credential|auth|bearer|private|api_?key|access_?key|signing|encryption|client_?id|session|cookie|webhook|license_?key|conn(?:ection)?_?str)[\w-]*", re.ASCII | re.IGNORECASE)
CONTEXT_WORDS = ("secret", "token", "passw", "pwd", "credential", "auth", "bearer", "private", "key", "signing", "encryption", "client", "session", "cookie", "webhook", "conn")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
#: What may lie between a sensitive name and its value on a later line, and the blocks of encoded private keys (line ends also written as \\n).
GAP = re.compile(r"""["'\x60)\]]*[ \t\r\n]*(?:(?::=|=>|[:=])[ \t\r\n]*)?[\\|>("'\x60\[ \t\r\n-]*""")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"(?:\s|\\[nr]|[\"'+,])*((?:[A-Za-z0-9+/=]{16,}(?:(?:\s|\\[nr]|[\"'+,])+[A-Za-z0-9+/=]{4,})*)?)")
#: Key characters without the letter of a written line end.
RUN = re.compile(r"(?:(?<!\\)[A-Za-z0-9+/_=.~-]|(?<=\\)[^nr\W])[A-Za-z0-9+/_=.~-]*|(?<=\\[nr])[A-Za-z0-9+/_=.~-]+")
#: Identifier dictionary: what code around a secret is made of.
IDENTIFIERS = " ".join(
    """abstract access account action address admin algorithm allow api app application args array async attribute auth authorization aws
    backend base64 begin bearer binary bool boolean branch buffer build bucket cache callback certificate channel char class client cloud
    code column commit config configuration connection const constructor content context cookie count create credential currency current
    customer data database date debug default define delete deploy description development directory document domain double element email
    enable encode encoding encryption endpoint engine entity environment error event example exception execute expire export extends false
    field file filter final finally float folder format frontend function generate generator get github global group handle handler hash
    header host html http https identifier image implements import include index init input insert instance integer interface internal
    invalid issue json kernel key keyword label lambda language length library license limit list load local localhost location log logger
    login main manager master message metadata method middleware mode model module name namespace network node null number object offset
    option order organization output package parameter parent parse password path pattern payload permission plugin port postgres prefix
    print private process production profile project property protected protocol provider public query queue random read redirect redis
    region register release remote remove replace repository request required reset resource response result return role root route row
    schema scope script search secret secure select self sender server service session setting signature source staging start state static
    status storage store stream string struct submit subscription success super switch symbol system table target task temp template test
    text thread throw time timeout timestamp title token total trace transaction transfer trigger true type undefined union unique unknown
    update upload url user username utils valid validate value variable vector verify version view void volume webhook while window worker
    write 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ""".split()
)

_level = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)


def _size(data: bytes, primer: bytes) -> int:
    made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=_level)
    return len(made.compress(data))


def novelty(text: str, start: int, end: int, around: int = 200, piece: int = 64) -> float:
    """Marginal compressed bytes of text[start:end] for each of its own bytes, the identifiers and the code around it known. Long strings are measured in pieces, each with what is before it known: letters of a long string that only differ in frequency would compress by entropy coding alone."""
    if end - start > piece:
        parts = -(-(end - start) // piece)
        cuts = [start + (end - start) * i // parts for i in range(parts + 1)]
        return sum(novelty(text, a, b, around) * (b - a) for a, b in zip(cuts, cuts[1:])) / (end - start)
    before, after = text[max(0, start - around) : start], text[end : end + around]
    primer = f"{IDENTIFIERS} {after} {before}".encode("utf-8", "surrogatepass")
    near, own = before[-32:].encode("utf-8", "surrogatepass"), text[start:end].encode("utf-8", "surrogatepass")
    return (_size(near + own, primer) - _size(near, primer)) / len(own)


def mean_novelty(text: str, start: int, end: int) -> float:
    """Novelty of the strings keys are made of in text[start:end]: all of a candidate, and of a block's body what lies between its line ends."""
    runs = [(m.start(), m.end()) for m in RUN.finditer(text, start, end)]
    return sum(novelty(text, a, b) * (b - a) for a, b in runs) / sum(b - a for a, b in runs)


@cache
def _steps() -> dict[str, float]:
    """Bits by which each pair of small letters is likelier in the identifiers than in a random key of 62 characters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [w for w in IDENTIFIERS.lower().split() if w.isalpha() and len(w) < 20]
    pairs = Counter(x + y for w in words for x, y in zip(w, w[1:]))
    first = Counter(w[i] for w in words for i in range(len(w) - 1))
    return {x + y: math.log2((pairs[x + y] + 0.5) / (first[x] + 13) * 62) for x in letters for y in letters}


def spelled(s: str) -> float:
    """Mean bits a step by which a string is likelier spelled from words than drawn at random: over one for words, identifiers and paths."""
    bits, steps = 0.0, _steps()
    for x, y in zip(s, s[1:]):
        if x.isalpha() and y.isalpha():
            # A capital inside a word begins another one; capitals go on as capitals.
            bits += -3.0 if x.islower() and y.isupper() else steps[x.lower() + y.lower()]
        elif x.isalnum() and y.isalnum():
            bits -= 3.0 if x.isdigit() != y.isdigit() else 0.0
    return bits / (len(s) - 1)


def candidates(text: str, reach: int) -> Iterator[tuple[int, int]]:
    """Strings keys are made of, with a letter, that begin after a sensitive word within ``reach`` on its line, or past line ends where only ``GAP`` lies between; bodies of key blocks as one. One pass over the text."""
    words = CONTEXT.finditer(text)
    word, stop, after = next(words, None), -1, -1
    blocks = key_blocks(text)
    block = next(blocks, None)
    for m in CANDIDATE.finditer(text):
        while word and word.end() <= m.start():
            gap = GAP.match(text, word.end()).end()
            stop = word.end() + reach
            line = text.find("\n", word.end(), stop)
            stop = stop if line < 0 else line
            after = gap
            word = next(words, None)
        while block and block[1] <= m.start():
            yield block
            block = next(blocks, None)
        if block and m.end() > block[0]:
            continue
        if (m.start() < stop or m.start() == after) and any(c.isalpha() for c in m[0]):
            yield m.start(), m.end()
    while block:
        yield block
        block = next(blocks, None)


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Bodies of BEGIN ... PRIVATE KEY blocks, without the lines of dashes and white space at the ends. A block ends at its END line, or where a line is no part of a body."""
    for m in BLOCK.finditer(text):
        body = BODY.match(text, m.end())
        if body[1]:
            yield body.start(1), body.end(1)


def spans(text: str | None, least: float = 0.8, reach: int = 48, most: float = 1.0) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then in the order of KINDS."""
    if not text:
        return []
    found, low = [], text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        base = {(x, y) for _, x, y in found}
        for start, end in candidates(text, reach):
            if (start, end) not in base and mean_novelty(text, start, end) >= least and spelled(text[start:end]) < most:
                found.append(("novel", start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def span_text(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            all_spans = spans(text)
            base = [s for s in all_spans if s[0] != "novel"]
            counts = [sum(s[0] == k for s in all_spans) for k in KINDS]
            for column, v in zip(out, (*counts[:3], hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(all_spans), counts[3])):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())))], names=[c.split()[0] for c in SCHEMA.split(", ")])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row, where the text lies: no shuffle."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_scan, SCHEMA)
