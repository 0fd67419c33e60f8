"""Secret scans: plain spans against SQL, structures that hold and that don't, awkward rows."""

import base64
import hashlib
import json
import random

import pytest
from helpers import DATA, awkward, duck

from tickspark.llm import secret_scan as scan

PATTERNS = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def plain_by_sql(c):
    """{doc_id: (counts, digest)}: matches and what stands between them give the places."""
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        quoted = pattern.replace("'", "''")
        value = f"regexp_extract(m[i], '{quoted}', 2)" if kind == "assign" else "m[i]"
        least = {"assign": 8, "access": 16, "hex": 32}[kind]
        parts.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, start, start + len(m[i]) AS past FROM (SELECT doc_id, m, i, list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS start
          FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, regexp_split_to_array(text, '{quoted}') AS b FROM documents))) WHERE len({value}) >= {least}""")
    rows = c.execute(f"""SELECT doc_id, count(k) FILTER (k = 0), count(k) FILTER (k = 1), count(k) FILTER (k = 2), sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(past AS BIGINT), ',' ORDER BY start, k), ''))
      FROM documents LEFT JOIN ({" UNION ALL ".join(parts)}) USING (doc_id) GROUP BY doc_id""").fetchall()
    return {r[0]: r[1:] for r in rows}


def test_plain_spans_equal_sql(spark):
    larger = DATA.replace("sf0.001", "sf0.1")  # the smallest tables hold none
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in scan.op11_secret_scan(spark, larger).collect()}
    assert got == plain_by_sql(duck(larger)) and sum(sum(v[:3]) for v in got.values()) > 0


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def rsa(rng, bits=1024):
    return tlv(0x30, number(0), number(rng.getrandbits(bits) | 1 << bits - 1), number(65537), *(number(rng.getrandbits(bits // 2)) for _ in range(6)))


ALGORITHM = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5))


def wrapped(rng):
    return tlv(0x30, number(0), ALGORITHM, tlv(4, rsa(rng)))


def curve(rng):
    return tlv(0x30, number(1), tlv(4, rng.randbytes(32)), tlv(0xA0, tlv(6, bytes.fromhex("2a8648ce3d030107"))), tlv(0xA1, tlv(3, b"\0\4" + rng.randbytes(64))))


def encrypted(rng):
    return tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")), tlv(0x30, number(5))), tlv(4, rng.randbytes(64)))


def openssh(rng):
    s = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(rng.randbytes(51)) + s(rng.randbytes(136))


def public(rng):
    return tlv(0x30, ALGORITHM, tlv(3, b"\0" + tlv(0x30, number(rng.getrandbits(1024)), number(65537))))


def token(rng, alg="HS256", n=32):
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([part(json.dumps({"alg": alg, "typ": "JWT"}).encode()), part(json.dumps({"sub": "x", "n": rng.randrange(99)}).encode()), part(rng.randbytes(n))])


def lines(text, width=64):
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("make", [rsa, wrapped, curve, encrypted, openssh])
def test_keys_are_found_whole_and_only_whole(make):
    rng = random.Random(4)
    data = make(rng)
    one = base64.b64encode(data).decode()
    for text, kind in ((f"é key {one} end", "key"), (f"é ({lines(one)}) end", "key"), (f"é {lines(one, 76)}\nend", "key"), (f"x/{data.hex()}.", "key"), (f"x:{data.hex().upper()}.", "key"), (f"-----BEGIN PRIVATE KEY-----\n{lines(one)}\n-----END PRIVATE KEY-----", "pem")):
        found = [s for s in scan.spans(text) if s[0] in ("key", "pem", "token")]
        assert [s[0] for s in found] == [kind], text
        body = text[found[0][1] : found[0][2]].replace("\n", "")
        assert body.rstrip("=") in (one.rstrip("="), data.hex(), data.hex().upper()) or kind == "pem"
    armour = f"-----BEGIN PRIVATE KEY-----\n{lines(one)}\n-----END PRIVATE KEY-----\n"
    assert [s[0] for s in scan.confirmed_spans("k " + base64.b64encode(armour.encode()).decode())] == ["key"]
    assert [s[0] for s in scan.confirmed_spans("prefix/" + one)] == ["key"]
    for wrong in (data[:-1], data + b"\0", data[:1] + bytes([data[1] ^ 1]) + data[2:], rng.randbytes(len(data)), public(rng)):
        assert not list(scan.confirmed_spans(base64.b64encode(wrong).decode()))
        assert not list(scan.confirmed_spans(wrong.hex()))
    assert not list(scan.confirmed_spans(armour.replace("BEGIN PRIVATE", "BEGIN PUBLIC").replace("END PRIVATE", "END PUBLIC").replace(one[:8], "AAAAAAAA")))


def test_armour_that_is_encrypted_by_its_header_or_escaped():
    rng = random.Random(5)
    body = lines(base64.b64encode(rng.randbytes(160)).decode())
    armour = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert list(scan.confirmed_spans(armour)) == [("pem", 0, len(armour))]
    assert not list(scan.confirmed_spans(armour.replace("DEK-Info", "Comment")))
    escaped = f"-----BEGIN EC PRIVATE KEY-----\n{lines(base64.b64encode(curve(rng)).decode())}\n-----END EC PRIVATE KEY-----".replace("\n", "\\n")
    assert list(scan.confirmed_spans(f'{{"k": "{escaped}"}}')) == [("pem", 7, 7 + len(escaped))]


def test_tokens_need_a_header_and_a_signature_of_its_length():
    rng = random.Random(6)
    good = token(rng)
    assert list(scan.confirmed_spans(f"a {good}, b")) == [("token", 2, 2 + len(good))]
    for wrong in (token(rng, n=31), token(rng, alg="ES512"), good.replace("eyJ", "eyK", 1), "www.example-of-a-long-name.com", good.split(".", 1)[1]):
        assert not list(scan.confirmed_spans(wrong))
    assert [s[0] for s in scan.confirmed_spans(token(rng, alg="PS256", n=256))] == ["token"]


def test_a_short_match_takes_its_place():
    assert list(scan.plain_spans("token=token:abcdefghij")) == []
    assert list(scan.plain_spans("PassWd' := \"abcdefgh")) == []
    assert list(scan.plain_spans("API_KEY'  =  \"abcdefgh\"")) == [("assign", 0, 22)]
    assert list(scan.plain_spans("toKen=abcdefgh ſecret=abcdefgh")) == []  # letters of ASCII alone
    assert list(scan.plain_spans("AKIAAKIA1 AKIA" + "Z" * 12)) == [("access", 10, 26)]
    assert list(scan.plain_spans("é" + "a" * 31 + "g" + "b" * 32)) == [("hex", 33, 65)]


def test_long_runs_are_scanned_in_linear_time():
    rng = random.Random(7)
    run = base64.b64encode(rng.randbytes(1_500_000)).decode()
    armours = "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n" * 20_000
    assert [s[0] for s in scan.confirmed_spans(run + " " + armours + " " + token(rng))] == ["token"]


def test_awkward_rows_and_redaction(spark):
    df = awkward(spark)
    found = scan.findings(df, keep=("doc_id", "kept", "n_hit"))
    assert found.columns == ["doc_id", "kept", "n_hit", "spans"] and found.count() == df.count()
    clean = scan.redacted(df)
    assert clean.columns == df.columns and sorted(map(str, clean.collect())) == sorted(map(str, df.collect()))
    assert scan.findings(df.limit(0)).count() == scan.redacted(df.limit(0)).count() == 0
    rng = random.Random(8)
    jwt, key = token(rng), base64.b64encode(rsa(rng)).decode()
    text = f"ü token={jwt} and {key}; AKIA{'Q' * 16}"
    df = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 6)], "doc_id long, text string, spans long")
    rows = scan.redacted(df, "#").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, "ü # and #; #", 5)] * 2 + [(2, None, 6)]
    listed = scan.findings(df, keep=("doc_id", "spans")).first()
    assert listed[0] == 1 and [s["kind"] for s in listed[2]] == ["assign", "token", "key", "access"]


def test_query_of_empty_and_null_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "x"), (4, "secret: abcdefgh")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in scan.op11_secret_scan(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == got[3] == (0, 0, 0, nothing, "")
    assert got[4] == (1, 0, 0, hashlib.sha256(b"assign:0:16").hexdigest(), "assign:0:16")
