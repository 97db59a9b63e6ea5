"""URL filtering by a bit-parallel wildcard automaton.

Glob rules are packed into the bits of several 64-bit words. One Shift-And step per character advances every
position of every pattern for every URL of a batch: numpy runs over the URLs, the bits run over the patterns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

#: Site rules (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's.
SITE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Glob rules that judge what no site rule fits, over ``.host#path``; any match blocks. ``*`` is any run, ``?`` any one byte.
BLOCK_GLOBS = ("*casino*#*", "*free-bets*#*", "*cheap-pills*#*", "*.adult-*#*", "*.spam-*#*", "*.ads-*#*", "*-track.*#*", "*#*/wp-login*", "*#*.exe")


class GlobAutomaton:
    """All globs at once. A bit stands for a pattern position, ``*`` for a position that keeps itself."""

    def __init__(self, globs: Sequence[str]):
        chars: list[list[int]] = []  # for each pattern, its bytes; -1 is any byte
        loops: list[set[int]] = []
        for glob in globs:
            own: list[int] = []
            loop: set[int] = set()
            for b in glob.encode():
                if b == ord("*"):
                    loop.add(len(own))
                else:
                    own.append(-1 if b == ord("?") else b)
            chars.append(own)
            loops.append(loop)
        bits = sum(len(c) + 1 for c in chars)
        self.words = max(1, -(-bits // 64))
        self.mask = np.zeros((256, self.words), np.uint64)
        self.loop, self.first = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for own, loop in zip(chars, loops, strict=True):
            self._set(self.first, at)
            for i in loop:
                self._set(self.loop, at + i)
            for i, b in enumerate(own):
                for x in range(256) if b < 0 else (b,):
                    self._set(self.mask[x], at + i + 1)
            self.last.append(((at + len(own)) // 64, np.uint64(1 << ((at + len(own)) % 64))))
            at += len(own) + 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, patterns) booleans: which pattern matches the whole of which text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        return self.match_bytes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(lengths))))

    def match_bytes(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The same for texts that lie in ``data`` from each offset to the next."""
        lengths = np.diff(offs)
        out = np.zeros((len(lengths), len(self.last)), bool)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offs[:-1][order], lengths[order]
        state = np.tile(self.first, (len(lengths), 1))
        live = len(lengths)
        for i in range(int(lengths[0]) if live else 0):
            while live and lengths[live - 1] <= i:
                live -= 1
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            moved &= self.mask[data[begin[:live] + i]]
            moved |= d & self.loop
            state[:live] = moved
        for k, (word, bit) in enumerate(self.last):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^?#]*", 0)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "(?s)^[^/]*(.*)$", 1), F.lit(""))


def filter_urls(pages: DataFrame, url_col: str = "url", site_rules: Sequence[tuple[str, str, str]] = SITE_RULES, block_globs: Sequence[str] = BLOCK_GLOBS, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and glob appended (columns of these names are replaced).

    Every site rule becomes the glob ``*.host#path*`` over ``.host#path`` (``#`` can't stand in a host or path), so the
    automaton simulates site rules and block globs together; of the site rules that match, the longest wins, and of
    equally long ones the first given; without one, the first block glob that matches blocks, else the verdict is
    ``default``. Null and malformed URLs have an empty host and path. Very long URLs are matched whole: a step a byte,
    for the rows of a batch that are still that long. Bytes of ``*`` or ``?`` in site rules aren't supported. Empty tables
    give no rows; repeated rows are judged alike; other columns, nulls in them included, come back as they are.
    """
    names = [f"{h}{p}" for h, p, _ in site_rules]
    ranked = sorted(range(len(names)), key=lambda i: -len(names[i]))
    globs = [f"*.{h}#{p}*" for h, p, _ in site_rules] + list(block_globs)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "glob")]
    host, path = canonical(F.col(f"`{url_col}`").cast("string"))
    frame = pages.select(*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"))
    frame = frame.withColumn("rule", F.concat(F.lit("."), "host", F.lit("#"), "path"))
    # what the first pattern in order says, by its number; the last stands for no match
    rules = pa.array([*(names[i] for i in ranked), *(None for _ in block_globs), None], pa.string())
    says = pa.array([*(site_rules[i][2] for i in ranked), *("block" for _ in block_globs), default], pa.string())
    by = pa.array([*(None for _ in ranked), *block_globs, None], pa.string())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = GlobAutomaton([*(globs[i] for i in ranked), *block_globs])
        for b in batches:
            hit = [np.zeros((0, len(rules)), bool)]
            for _, _, buf, offs in text_slices(b.column(b.num_columns - 1)):
                found = machine.match_bytes(buf, offs)
                hit.append(np.column_stack([found, np.ones(len(found), bool)]))
            first = pa.array(np.concatenate(hit).argmax(1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], rules.take(first), says.take(first), by.take(first)], names=[*b.schema.names[:-1], "rule", "verdict", "glob"])

    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(judge, f"{full}, verdict string, glob string")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_REST = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END"
OP3_SQL = f"""
WITH a AS (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM a),
c AS (SELECT *, '.' || host AS h FROM b),
d AS (SELECT page_id, host, path, h, CASE
    WHEN h LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN h LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN h LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN h LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN h LIKE '%casino%' OR h LIKE '%free-bets%' OR h LIKE '%cheap-pills%' OR h LIKE '%.adult-%' OR h LIKE '%.spam-%'
      OR h LIKE '%.ads-%' OR h LIKE '%-track.%' OR path LIKE '%/wp-login%' OR path LIKE '%.exe' THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
"""
