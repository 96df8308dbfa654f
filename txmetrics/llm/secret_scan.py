"""Secret scan: patterns, and strings that a primed compressor cannot explain.

Besides the spans of fixed patterns, candidates are long unbroken strings near a sensitive word. A
candidate's novelty is the number of bytes it adds to the compressed size of the text around it,
with a zstandard dictionary of common code and identifiers, per character. Ordinary identifiers and
strings seen nearby cost almost nothing; random strings cost most of their entropy.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from txmetrics.llm.frames import map_texts, pick

KINDS = ("assign", "access", "hex", "novel")

# The base patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make the text near them sensitive; the parts of one may be joined by ``_``, ``-``, a space or a capital.
SENSITIVE = (
    "password passwd passphrase pwd secret token api_key access_key private_key credential auth authorization bearer "
    "signature signing_key encryption_key session_id cookie jwt connection_string account_key"
).split()
# a word of an identifier begins after no letter or where the case changes, and may be plural
_SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))(?i:"
    + "|".join(w.replace("_", "[-_\\x20]?") for w in sorted(SENSITIVE, key=len, reverse=True))
    + r")(?i:s)?(?![a-z])",
    re.ASCII,
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")


def sensitive_words(text: str) -> list[tuple[int, int]]:
    """Where sensitive words stand, also inside identifiers: ``authToken``, ``DB_PASSWORDS``, ``private key``."""
    found = (m.span() for m in _SENSITIVE.finditer(text))
    # a word in capitals ends where the capitals do: TOKENIZER holds none
    return [(a, b) for a, b in found if not (text[a:b].isupper() and text[b : b + 1].isupper())]


#: Text that code and configuration are full of; strings made of such pieces are not secrets.
IDENTIFIERS = (
    "import from return class function const let var public private static void string int float double boolean null true "
    "false self this new def end if else for while try except catch throw finally async await export default require module "
    "package namespace include define struct enum interface extends implements override virtual template typename "
    "getElementById addEventListener querySelector innerHTML toString parseInt stringify JSON console.log print printf "
    "username user_name user_id email address localhost example placeholder changeme your_api_key_here your-token-here "
    "process.env os.environ getenv config settings configuration credentials authentication authorization application "
    "application/json text/html charset=utf-8 Content-Type Accept Authorization Bearer Basic X-Api-Key https://www. http:// "
    ".com .org .net /api/v1/ /api/v2/ /usr/local/bin /home/user /var/log index main utils helper service controller "
    "repository manager handler factory builder provider client server request response session cookie database connection "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX ________ --------"
)


@dataclass(frozen=True)
class Settings:
    """``reach``: characters on either side of a candidate in which a sensitive word counts, and of context
    that prime the compressor. ``least``: the shortest candidate. ``novelty``: marginal
    compressed bytes per character from which a candidate is reported (random letters and digits
    cost about 0.75, random hex digits 0.5)."""

    reach: int = 64
    least: int = 16
    novelty: float = 0.55


@dataclass
class Novelty:
    """Marginal compressed sizes under a primed dictionary."""

    settings: Settings
    compressor: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            19, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=parameters)

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes per character that text[start:end] adds to the compressed text around it."""
        reach = self.settings.reach
        around = (text[max(0, start - reach) : start] + "\n" + text[end : end + reach] + "\n").encode()
        alone = len(self.compressor.compress(around))
        return (len(self.compressor.compress(around + text[start:end].encode())) - alone) / (end - start)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, kind by kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    """Candidates near a sensitive word, on either side, that overlap no span of ``taken`` and that compress badly."""
    settings, out = novelty.settings, []
    words = sensitive_words(text)
    if not words:
        return out
    starts, ends = [a for a, _ in words], [b for _, b in words]
    begins = sorted((a, b) for _, a, b in taken)
    furthest = list(accumulate((b for _, b in begins), max))
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        if end - start < settings.least:
            continue
        before, after = bisect_right(ends, start) - 1, bisect_left(starts, end)
        near = before >= 0 and start - ends[before] <= settings.reach or after < len(starts) and starts[after] - end <= settings.reach
        if near and not _overlaps(begins, furthest, start, end) and novelty.of(text, start, end) >= settings.novelty:
            out.append(("novel", start, end))
    return out


def _overlaps(begins: list[tuple[int, int]], furthest: list[int], start: int, end: int) -> bool:
    """Whether [start, end) meets a held span: one that begins before ``end`` reaches past ``start``."""
    before = bisect_left(begins, (end, -1))
    return before > 0 and furthest[before - 1] > start


def order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The secrets of every document.

    Returns ``doc_id`` and ``secrets``, an array of (kind, start, end, novelty) by start, then kind;
    positions are code points, end exclusive. Base patterns have no novelty. A null or empty text
    has an empty array. Rows are judged one by one, so repeated rows and null ids stay; an empty table
    gives no rows. Other columns are not read, so their names and nulls do not matter.
    """

    def each(ids, texts, novelty: Novelty):
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            found = order(base + novel_spans(text, base, novelty))
            rows.append([{"kind": k, "start": a, "end": b, "novelty": novelty.of(text, a, b) if k == "novel" else None} for k, a, b in found])
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
        )
        return {"doc_id": ids, "secrets": pa.array(rows, kind)}

    schema = "doc_id, secrets array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"
    return map_texts(pick(docs, id_column, text_column), schema, each, lambda: Novelty(settings))
