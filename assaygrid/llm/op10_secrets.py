"""Secret scan: keyword automaton, anchored patterns near its hits, checksums of what is found (operator 10).

An Aho-Corasick automaton over lower-cased text finds keywords; each pattern is tried only at such a hit, anchored
there.  Hex runs have no keyword: a scan for long runs finds them.  Kinds with a built-in checksum (repository
access tokens with a CRC-32 tail, bank account numbers, web tokens with a JSON head) are kept only when it holds.
Per kind, matches are leftmost and do not overlap, as one pass of the pattern over the text would give them; a
match that is too short still uses up its text.  Positions are code points, ends exclusive.

Null texts count as empty; null or repeated doc_ids are returned row by row; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from base64 import urlsafe_b64decode

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import slices, table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "repo_token", "iban", "jwt")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62_ok(token: str) -> bool:
    """The last six base-62 digits of a repository token are the CRC-32 of the part between prefix and tail."""
    body, tail = token[token.index("_") + 1 : -6], token[-6:]
    value, text = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        text = DIGITS62[d] + text
    return text == tail


def iban_ok(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def jwt_ok(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def detectors() -> dict:
    """kind: keywords in lower case, pattern anchored at the keyword, test of a match."""
    any_case, exact = re.ASCII | re.IGNORECASE, re.ASCII
    return {
        "assign": (
            ("password", "passwd", "secret", "token", "apikey", "api_key"),
            re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case),
            lambda m: len(m[1]) >= 8,
        ),
        "access": (("akia",), re.compile("AKIA[A-Z0-9]+", exact), lambda m: len(m[0]) >= 16),
        "repo_token": (
            ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
            re.compile("(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])", exact),
            lambda m: crc62_ok(m[0]),
        ),
        "iban": (("iban",), re.compile(r"IBAN[\x20:=]{0,3}([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Z0-9])", exact), lambda m: iban_ok(m[1])),
        "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}", exact), lambda m: jwt_ok(m[0])),
    }


HEX_RUN = "[0-9a-f]{32,}"


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = detectors()
        self.hits = ahocorasick.Automaton()
        for kind, (words, _, _) in self.rules.items():
            for w in words:
                self.hits.add_word(w, (kind, len(w)))
        self.hits.make_automaton()
        self.hex = re.compile(HEX_RUN)
        self.lower = {c: c + 32 for c in range(65, 91)}

    def __call__(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, matched text) by start, then kind as listed."""
        low = text.lower()
        if len(low) != len(text):  # a few letters lower-case to more than one code point
            low = text.translate(self.lower)
        found = []
        begins: dict[str, list[int]] = {}
        for end, (kind, n) in self.hits.iter(low):
            begins.setdefault(kind, []).append(end - n + 1)
        for kind, at in begins.items():
            _, pattern, holds = self.rules[kind]
            free = 0
            for p in sorted(at):
                if p >= free and (m := pattern.match(text, p)):
                    free = m.end()
                    if holds(m):
                        found.append((m.start(), m.end(), kind, m[0]))
        found += [(m.start(), m.end(), "hex", m[0]) for m in self.hex.finditer(text)]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, found): found is the list of (kind, start, end, secret), empty for clean texts."""
    schema = "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,secret:string>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

    def run(batches):
        scan = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[{"kind": k, "start": s, "end": e, "secret": x} for s, e, k, x in scan(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]`` and n_chars (if there) counted anew; other columns as they are."""
    schema = docs.schema
    names = docs.columns

    def run(batches):
        scan = Scanner()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for i, t in enumerate(texts):
                    while found := scan(t or ""):  # what a redaction uncovers is redacted too
                        out, done = [], 0
                        for s, e, k, _ in found:
                            if e > done:
                                out += [t[done : max(s, done)], f"[{k}]" if s >= done else ""]
                                done = e
                        t = "".join(out) + t[done:]
                    texts[i] = t
                cols = {n: part.column(n) for n in names}
                cols["text"] = pa.array(texts, cols["text"].type)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda kinds: F.array_join(
        F.transform(F.filter("found", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )
