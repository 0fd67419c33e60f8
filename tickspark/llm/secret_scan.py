"""Secret scans: three plain patterns, and candidates that are decoded and confirmed by their structure.

Plain patterns (assignments to a password-like name, access key numbers, long hex strings) are reported as they match. On
top of them every run of base64 or hex digits is decoded, and reported only if what comes out parses to its last byte:

* ``pem``: an armoured private key whose body holds one of the encodings below (or is encrypted by its own header);
* ``key``: a private key in nested tag-length-value form (RSA, DSA, EC, wrapped, encrypted, a key store) or in the
  length-prefixed form of OpenSSH, in base64 or hex, or armoured text in base64 once more;
* ``token``: three dotted parts of which the first is a header that names its algorithm, the second an object, and the
  third as long a signature as the algorithm makes.

Every length must end where the one around it does, so that random strings and public keys stay out. What lies within a
``pem`` isn't reported again. Offsets count code points of the whole text, ends are exclusive.

Edge cases: a null or empty text has no spans; a very long text is scanned whole; spans of different kinds may overlap and
are all listed; repeated rows are scanned each; an empty table gives no rows; other columns are kept or ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.text import bounded_batches, given_back, set_aside


def either_case(words: str) -> str:
    """A pattern for ASCII letters in either case, and for those alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The plain patterns, and how long a match must be (of an assignment, its value).
ASSIGN = re.compile(f"(?:{either_case('password|passwd|secret|token|api_?key')})" r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

#: Kinds in the order in which spans of one start are listed; the first three are the plain ones.
KINDS = ("assign", "access", "hex", "pem", "key", "token")
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
FIELDS = "spans array<struct<kind:string,start:long,end:long>>"

ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=:,. \t\r\n]|-(?!----)|\\n|\\r)*)-----END \1-----")
#: Lines of equal width may run on; a candidate is too short for a key below so many digits.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:(?:[A-Za-z0-9+/]{64}\r?\n)+|(?:[A-Za-z0-9+/]{76}\r?\n)+)[A-Za-z0-9+/]{0,76}|[A-Za-z0-9+/_-]{24,})={0,2}")
DIGITS = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{3,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Within a run of base64, where an encoding may start: an outer sequence, the mark of OpenSSH, or armour once more encoded.
STARTS = re.compile(r"(?:^|(?<=[/+_-]))(?=M[A-P]|b3Bl|LS0t)")

#: Bytes of a signature by algorithm, and the beginnings of the identifiers of password-based encryption and of
#: a key store's content.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
STORED = bytes.fromhex("2a864886f70d0107")
INTEGER, BITS, OCTETS, NAME, SEQUENCE, FIRST, SECOND = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the value) of the element at ``at``, if its length is in shortest form and ends by ``end``."""
    if at + 2 > end:
        return None
    tag, n, start = data[at], data[at + 1], at + 2
    if n >= 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or start + width > end or not data[start]:
            return None
        n, start = int.from_bytes(data[start : start + width], "big"), start + width
        if n < 0x80:
            return None
    return (tag, start, start + n) if start + n <= end else None


def elements(data: bytes, start: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The elements that fill [start, end), if they do so exactly."""
    found = []
    while start < end:
        one = element(data, start, end)
        if one is None or len(found) == most:
            return None
        found.append(one)
        start = one[2]
    return found


def nested_key(data: bytes) -> bool:
    """Whether the bytes are a private key, or a store of them, in nested tag-length-value form."""
    outer = element(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE or outer[2] != len(data):
        return False
    parts = elements(data, *outer[1:]) or []
    tags = [p[0] for p in parts]
    value = lambda p: data[p[1] : p[2]]
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:  # encrypted: how, and what
        inner = elements(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == NAME and value(inner[0]).startswith(ENCRYPTED) and parts[1][2] > parts[1][1]
    if not parts or tags[0] != INTEGER:
        return False
    version, rest = value(parts[0]), tags[1:]
    if set(rest) == {INTEGER}:  # RSA has a modulus and seven more numbers, DSA five in all
        return (version, len(rest)) in ((b"\0", 8), (b"\0", 5)) and parts[1][2] - parts[1][1] >= 32
    if rest[:2] == [SEQUENCE, OCTETS] and set(rest[2:]) <= {FIRST, SECOND, 0x81}:  # wrapped: for which algorithm, and the key
        inner = elements(data, *parts[1][1:])
        return version in (b"\0", b"\1") and bool(inner) and inner[0][0] == NAME and parts[2][2] > parts[2][1]
    if rest[:1] == [OCTETS] and set(rest[1:]) <= {FIRST, SECOND}:  # elliptic curve: a number, its curve, its point
        inner = [elements(data, *p[1:]) for p in parts[2:]]
        return version == b"\1" and parts[1][2] - parts[1][1] >= 16 and all(x and x[0][0] in (NAME, SEQUENCE, BITS) for x in inner)
    if version == b"\3" and rest[:1] == [SEQUENCE]:  # a store
        inner = elements(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == NAME and value(inner[0]).startswith(STORED)
    return False


def prefixed_key(data: bytes) -> bool:
    """Whether the bytes are a private key of OpenSSH: a mark, three strings, public keys and the private part, to the end."""
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return False

    def string(at: int) -> int:
        """The end of the string at ``at``; past all data if it doesn't fit."""
        return at + 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1

    at = string(string(string(len(mark))))
    many = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
    if not 1 <= many <= 16:
        return False
    at += 4
    for _ in range(many + 1):
        at = string(at)
    return at == len(data)


def decoded(digits: str) -> bytes | None:
    """What base64 digits of either alphabet stand for; line breaks and padding don't matter."""
    digits = digits.replace("\r", "").replace("\n", "").rstrip("=").translate({45: 43, 95: 47})
    if len(digits) % 4 == 1:
        return None
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def may_fit(run: str, at: int) -> bool:
    """Whether an outer sequence that starts at a place of a run of base64 says that it ends with the run: a look at its first
    digits, so that a long run isn't decoded over and over. Other beginnings may."""
    if run[at] != "M":
        return True
    head = decoded(run[at : at + 8]) or b""
    if len(head) < 6 or head[0] != SEQUENCE:
        return False
    width = head[1] & 0x7F if head[1] >= 0x80 else 0
    stated = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    digits = len(run) - at - run.count("\n", at) - run.count("\r", at) - run.count("=", at)
    return width <= 4 and stated == digits * 3 // 4


def armoured(body: str) -> bool:
    """Whether what stands between the lines of an armoured key is one, or says that it is encrypted and is of whole blocks."""
    lines = [x.strip() for x in body.replace("\\n", "\n").replace("\\r", "").splitlines()]
    data = decoded("".join(x for x in lines if ":" not in x).replace(" ", ""))
    if not data:
        return False
    return any(x.startswith("DEK-Info:") for x in lines) and len(data) % 8 == 0 or nested_key(data) or prefixed_key(data)


def is_key(data: bytes | None) -> bool:
    if not data:
        return False
    if data.startswith(b"-----BEGIN "):
        return any(armoured(m[2]) for m in ARMOUR.finditer(data.decode("latin-1")))
    return nested_key(data) or prefixed_key(data)


def is_token(header: str, payload: str, signature: str) -> bool:
    """Whether dotted parts are a signed token."""
    try:
        head, body = (json.loads(decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    signed, n = decoded(signature), SIGNATURES.get(head["alg"])
    return signed is not None and (len(signed) == n if n is not None else len(signed) >= 32)


def plain_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Matches of the plain patterns; one that is too short takes its place in the text but isn't reported."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):  # runs end where the class does, so that a short one hides none
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def confirmed_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates whose structure was parsed."""
    pems = [(m.start(), m.end()) for m in ARMOUR.finditer(text) if armoured(m[2])] if "-----BEGIN " in text else []
    for start, end in pems:
        yield "pem", start, end
    inside = lambda m: any(a <= m.start() and m.end() <= b for a, b in pems)
    for m in BASE64.finditer(text):
        if not inside(m):
            runs = [m[0], m[0].rpartition("\n")[0].rstrip("\r")] if "\n" in m[0] else [m[0]]  # the last line may be one of prose
            tried = ((s.start(), len(run)) for run in runs for s in STARTS.finditer(run) if may_fit(run, s.start()) and is_key(decoded(run[s.start() :])))
            if found := next(tried, None):
                yield "key", m.start() + found[0], m.start() + found[1]
    for m in DIGITS.finditer(text):
        if len(m[0]) % 2 == 0 and not inside(m) and is_key(bytes.fromhex(m[0])):
            yield "key", m.start(), m.end()
    for m in TOKEN.finditer(text):
        if is_token(*m.groups()):
            yield "token", m.start(), m.end()


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by start, then kind, then end."""
    text = text or ""
    return sorted([*plain_spans(text), *confirmed_spans(text)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def findings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and FIELDS of every row."""
    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py())] for t in b.column("_text")]
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(found, SPAN)], [*names, "spans"])

    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("_text"))
    made = rows.mapInArrow(run, ", ".join([*(f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)), FIELDS]))
    return made.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "spans")


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of text that spans cover replaced by ``mask``; null texts stay null."""
    aside, names = set_aside(docs, "text")
    found = findings(aside, keep=(*names, "text"))
    past = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["end"] <= a["at"], a["out"]).when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], _between(F.col("text"), a["at"], s["start"]), F.lit(mask))).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(past["out"], _between(F.col("text"), past["at"], F.char_length("text").cast("long"))))
    at = docs.columns.index("text")
    return given_back(found.withColumn(names[at], text), names, docs.columns)


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *(many(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
