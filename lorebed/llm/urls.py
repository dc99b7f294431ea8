"""URL filter: all glob rules at once by a bit-parallel wildcard automaton.

Each glob takes one bit a state in a row of 64-bit words: bit j of a glob is on when its first j symbols have matched. Reading
a character is Shift-And: states move up one bit where that character fits, and states before a ``*`` also stay. The bits of all
globs move together, and a batch of URLs moves together; where few of them are that long, each moves by itself.

Canonical URL: a dot, the host (A-Z lower-cased), a separator, the path. ``*.net/x*`` style rules therefore fit a host and
its subdomains, and nothing in a path can pass for a host.

Nulls and other cases: a null url, or one without ``://``, has an empty host and path, fits no host rule, and gets the
method's verdict on the empty URL (allow); null page_ids and repeated rows are judged like others; an empty table gives
no rows; further columns of the input are ignored. URLs of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SEPARATOR = "\ue000"  # between host and path; in a URL itself it reads as another character
OTHER = "\ue001"
FEW = 12  # texts that are worth a vector step together
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Allow or block a host, all its subdomains, and of them the paths that start so."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query is given (fixed values).
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: What is blocked where no rule fits: globs over ``.host`` + separator + path, in any case.
BLOCKED = (
    *(f"*{word}*{SEPARATOR}*" for word in ("spam", "pills", "casino", "viagra", "porn", "xxx", "betting", "payday", "replica")),
    *(f"*{SEPARATOR}*/{part}/*" for part in ("ads", "adserver", "banners", "tracking", "cgi-bin", "wp-admin", "cart", "checkout")),
    *(f"*{SEPARATOR}*/{page}*" for page in ("wp-login", "login", "signup", "xmlrpc.php")),
    *(f"*{SEPARATOR}*.{end}" for end in ("exe", "zip", "gz", "apk", "dmg", "iso", "mp3", "mp4", "avi", "jpg", "jpeg", "png", "gif")),
    f"*.ads.*{SEPARATOR}*",
    f"*.adserver.*{SEPARATOR}*",
)


class GlobAutomaton:
    """``*`` is any run, ``?`` any one character, a backslash takes the next symbol as it is; globs cover the whole text."""

    def __init__(self, globs: list[tuple[str, bool]]):
        """Each glob with whether case counts (A-Z alone)."""
        starts, stays, ends, symbols, bit = [], [], [], [], 0
        for glob, exact in globs:
            starts.append(bit)
            at = 0
            while at < len(glob):
                c = glob[at]
                if c == "*":
                    stays.append(bit)
                else:
                    literal = c == "\\" and at + 1 < len(glob)
                    at += literal
                    bit += 1
                    fits = None if c == "?" else {glob[at]} if exact else {glob[at], glob[at].translate(_UP), glob[at].translate(_DOWN)}
                    symbols.append((bit, fits))
                at += 1
            ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        letters = sorted({x for _, fits in symbols if fits for x in fits})
        self.letters = np.array([ord(x) for x in letters], dtype=np.uint32)
        self.moves = np.zeros((len(letters) + 1, self.words), dtype=np.uint64)  # the last row: any other character
        for to, fits in symbols:
            for row in range(len(letters) + 1) if fits is None else [letters.index(x) for x in fits]:
                self.moves[row, to >> 6] |= np.uint64(1 << (to & 63))
        self.start, self.stay = self._mask(starts), self._mask(stays)
        self.whole_moves = [int.from_bytes(x.tobytes(), "little") for x in self.moves]
        self.whole_stay = int.from_bytes(self.stay.tobytes(), "little")
        self.ends = np.array(ends, dtype=np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            mask[bit >> 6] |= np.uint64(1 << (bit & 63))
        return mask

    def match(self, texts: list[str]) -> np.ndarray:
        """Which glob (column) matches which text (row)."""
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = np.searchsorted(self.letters, codes)
        found[found == len(self.letters)] = 0
        kinds = np.where(self.letters[found] == codes, found, len(self.letters)) if len(self.letters) else np.zeros(len(codes), int)
        begin = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (len(texts), 1))
        active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
        together = int(np.searchsorted(-active, -FEW, side="right"))  # steps that many texts take at once
        for step, n in enumerate(active[:together]):  # the n longest have a character here
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = moved & self.moves[kinds[begin[:n] + step]] | now & self.stay
        for i in range(active[together] if together < len(active) else 0):  # the rest of the long ones, each by itself in whole integers
            bits = int.from_bytes(state[i].tobytes(), "little")
            for kind in kinds[begin[i] + together : begin[i] + lengths[order[i]]].tolist():
                bits = bits << 1 & self.whole_moves[kind] | bits & self.whole_stay
            state[i] = np.frombuffer(bits.to_bytes(8 * self.words, "little"), dtype=np.uint64)
        out = np.empty((len(texts), len(self.ends)), dtype=bool)
        out[order] = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


_UP, _DOWN = str.maketrans(LOWER, UPPER), str.maketrans(UPPER, LOWER)
_AS_IS = str.maketrans({c: "\\" + c for c in "*?\\"})


class UrlFilter:
    """Rules decide where one fits, the longest first (then the longer host, then block); globs decide the rest."""

    def __init__(self, rules=RULES, blocked=BLOCKED):
        self.rules = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
        own = [(f"*.{r.host.translate(_AS_IS)}{SEPARATOR}{r.path.translate(_AS_IS)}*", True) for r in self.rules]
        self.automaton = GlobAutomaton(own + [(x, False) for x in blocked])

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        clean = [x.replace(SEPARATOR, OTHER) for x in hosts], [x.replace(SEPARATOR, OTHER) for x in paths]
        hit = self.automaton.match([f".{h}{SEPARATOR}{p}" for h, p in zip(*clean, strict=True)])
        n = len(self.rules)
        ruled = hit[:, :n].any(axis=1)
        which = hit[:, :n].argmax(axis=1) if n else np.zeros(len(hit), dtype=np.int64)
        listed = hit[:, n:].any(axis=1)
        rule = [self.rules[k].text if r else None for k, r in zip(which, ruled, strict=True)]
        verdict = [self.rules[k].verdict if r else "block" if b else "allow" for k, r, b in zip(which, ruled, listed, strict=True)]
        return rule, verdict


def judge(pages: DataFrame, rules=RULES, blocked=BLOCKED) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url)."""
    bound_batches(pages.sparkSession)

    def run(batches):
        judges = UrlFilter(rules, blocked)
        for batch in batches:
            if batch.num_rows:
                rule, verdict = judges.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                columns = [*batch.columns, pa.array(rule, type=pa.string()), pa.array(verdict)]
                yield pa.record_batch(columns, names=["page_id", "host", "path", "rule", "verdict"])

    parts = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract("url", parts, 1), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.regexp_extract("url", parts, 2), F.lit(""))
    cut = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    return cut.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_sql(rules=RULES, blocked=BLOCKED) -> str:
    """DuckDB SQL for the rows of ``judge``."""
    quote = lambda x: x.replace("'", "''")
    like = lambda x: quote(x.replace("!", "!!").replace("%", "!%").replace("_", "!_").replace("*", "%"))
    values = ", ".join(f"('{r.verdict}', '{quote(r.host)}', '{quote(r.path)}')" for r in rules)
    globs = " OR ".join(f"c LIKE '{like(x)}' ESCAPE '!'" for x in blocked)
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES {values}),
m AS (
  SELECT *, translate('.' || replace(host, '{SEPARATOR}', '{OTHER}') || '{SEPARATOR}' || replace(path, '{SEPARATOR}', '{OTHER}'), '{UPPER}', '{LOWER}') AS c,
         (SELECT arg_min(struct_pack(v := r.verdict, t := r.h || r.p), (-length(r.h || r.p), -length(r.h), r.verdict <> 'block'))
          FROM r WHERE (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p)) AS best
  FROM u)
SELECT page_id, host, path, best.t AS rule,
       coalesce(best.v, CASE WHEN {globs} THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
