import hashlib

import pytest
from pyspark.sql import functions as F

from sievework.functions import digests, pe
from sievework.operators import logic, parse, scan
from sievework.operators.patterns import PatternError
from sievework.operators.sigset import SignatureSet
from sievework.sources import container, directory, objects
from sievework.streaming.scan import Publisher, Settings, Snapshots, scan_stream, stale

# the standard harmless test string, put together here
SAMPLE = (r"X5O!P%@AP[4\PZX54(P^)7CC)7}$EICAR-STANDARD-" + "ANTIVIRUS-TEST-FILE!$H+H*").encode()
MD5, SHA256 = hashlib.md5(SAMPLE).hexdigest(), hashlib.sha256(SAMPLE).hexdigest()
FILES = {
    "daily.hdb": f"{MD5}:68:Test.Md5\nzz:1:x\naa:1\n# no\n{'0' * 32}:*:Nul:90\n",
    "daily.hsb": f"{SHA256}:*:Test.Sha\n",
    "daily.ndb": f"Test.Body:0:*:{SAMPLE[:20].hex()}:90:255\nbad\nEvil.Pe:1:*:4556494c\n",
    "daily.ldb": "Test.Logic;Target:0;0&1;41414141;42424242\nEvil.Count;Target:0;0=2,3;4556494c2121\nnope\n",
    "daily.mdu": "1:" + "0" * 32 + ":Unwanted\n",
    "readme.txt": "no",
}


def members(**more):
    return {k: v.encode() for k, v in (FILES | more).items()}


def scanned(spark, sigs, *contents):
    rows = spark.createDataFrame([(str(i), None if c is None else bytearray(c)) for i, c in enumerate(contents)], "object_id string, content binary")
    return {int(r.object_id): (r.result, r.signature, r.stage) for r in scan.verdict(rows, sigs).collect()}


def test_verdict_stages(spark):
    sigs = directory.load_unpacked(spark, members())
    got = scanned(spark, sigs, SAMPLE, b"hello world", SAMPLE + b" ", b"xAAAAyBBBB", b"EVIL!!EVIL!!", b"MZEVIL", b"EVIL", b"", None, b"EVIL!!")
    assert got[0] == ("infected", "Test.Sha", "hash") and got[1] == ("clean", None, "none")
    assert got[2] == ("infected", "Test.Body", "body") and got[3] == ("infected", "Test.Logic", "logical")
    assert got[4] == ("infected", "Evil.Count", "logical") and got[5] == ("infected", "Evil.Pe", "body")
    assert got[6][0] == got[7][0] == got[8][0] == got[9][0] == "clean"
    assert sigs.counters().first().asDict() == {"file_hash": 3, "section_hash": 0, "body": 2, "logical": 2, "skipped": 2}
    assert sigs.readiness().first().ready and not SignatureSet.empty(spark).readiness().first().ready


def test_ignore_and_allow(spark):
    sigs = directory.load_unpacked(spark, members(**{"a.ign": "Test.Sha\nEvil:*\n", "b.fp": hashlib.md5(SAMPLE + b" ").hexdigest() + ":1:any\n"}))
    got = scanned(spark, sigs, SAMPLE, SAMPLE + b" ", b"MZEVIL")
    assert got[0] == ("infected", "Test.Body", "body")  # an ignored digest does not fall back to another one
    assert got[1] == ("clean", None, "allowed") and got[2][0] == "clean"


def test_lookup(spark):
    sigs = directory.load_unpacked(spark, members())
    lines = [MD5, f"md5:{MD5.upper()}", '{"md5":"%s","size":1}' % MD5, '{"sha256":"%s","md5":"x"}' % SHA256, "{bad", "{}", "xyz", "abc", "abcd", "0" * 31 + "1", "  "]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, given string")
    rows = rows.select("line_no", *[c.alias(n) for n, c in objects.lookup_columns(F.col("given")).items()]).filter("line <> ''")
    got = {r.line_no: (r.result, r.signature, r.error) for r in scan.digest_lookup(rows, sigs).collect()}
    assert got[0] == got[1] == ("infected", "Test.Md5", None) and got[2] == ("clean", None, None) and got[3][1] == "Test.Sha"
    assert [got[i][2] for i in range(4, 10)] == ["invalid json", "invalid hash: unsupported length 0", "invalid hash: non-hex digest", "invalid hash: decode", "invalid hash: unsupported length 2", None]
    assert got[9][0] == "clean" and 10 not in got


def test_rules():
    assert parse.body_rule("T:0:*:414243:90:255").pattern.tokens == (("lit", b"ABC"),)
    rule = parse.logical_rule("T;Target:1,FileSize:1-9;(0|1)&2=2;aaaa;bbbb;0:cccc::w;")
    assert (rule.target, rule.file_size) == (1, (1, 9)) and rule.subs[2].offset.kind == "absolute" and rule.subs[2].pattern.anchor == b"\xcc\0\xcc\0"
    assert [logic.evaluate(rule.expression, h) for h in ([1, 0, 2], [0, 0, 2], [1, 0, 1])] == [True, False, False]
    assert parse.logical_rule("T;;0;41").target == 0
    for bad in ("x", "T;Target:x;0;41", "T;Target:0;(0;41", "T;Target:0;(0)=1;41", "T;Target:0;0;4"):
        with pytest.raises(PatternError):
            parse.logical_rule(bad)
    assert parse.member_kind("main.mdb") == "mdb" and parse.member_kind("main.mdu") is None and parse.member_kind("main.mdu", True) == "mdb"
    assert parse.member_kind("bytecode.cbc") is None and parse.member_kind("main.cvd.tmp") is None


def test_logic_column(spark):
    for text, hits, want in [("0&1|2", [0, 0, 1], True), ("0>1&1<2", [2, 1], True), ("0=1,3", [4], False), ("5", [1], False)]:
        tree = logic.parse(text)
        columns = [F.lit(h) for h in hits]
        assert logic.evaluate(tree, hits) == want == spark.range(1).select(logic.column(tree, columns).alias("x")).first().x


def image(sections=1):
    head = b"MZ".ljust(0x3C, b"\0") + (0x80).to_bytes(4, "little")
    coff = b"PE\0\0" + (0x14C).to_bytes(2, "little") + sections.to_bytes(2, "little") + bytes(12) + (0xE0).to_bytes(2, "little") + bytes(2)
    options = (0x10B).to_bytes(2, "little") + bytes(14) + (0x1000).to_bytes(4, "little") + bytes(0xE0 - 20)
    section = b".text\0\0\0" + b"".join(n.to_bytes(4, "little") for n in (0x200, 0x1000, 0x200, 0x200)) + bytes(16)
    return (head.ljust(0x80, b"\0") + coff + options + section).ljust(0x200, b"\0") + b"EVILCODE".ljust(0x200, b"\x90")


def test_pe(spark):
    data = image()
    parsed = pe.parse(data)
    assert parsed.ep_off == 0x200 and len(parsed.sections) == 1 and parsed.sections[0].raw_ptr == 0x200
    assert pe.parse(b"MZ not a pe") is None and pe.parse(b"\x7fELF") is None and pe.parse(data[:0x90]) is None
    body = hashlib.md5(data[0x200:0x400]).hexdigest()
    files = {"m.mdb": f"512:{body}:Sec.Evil\n", "n.ndb": "Ep:1:EP+0:4556494c\nSec:1:S0+0:4556494c\nLast:1:SL+4:434f4445\nMiss:1:EP+1:4556494c\n"}
    sigs = directory.load_unpacked(spark, {k: v.encode() for k, v in files.items()})
    assert scanned(spark, sigs, data)[0] == ("infected", "Sec.Evil", "section")
    df = spark.createDataFrame([("0", bytearray(data))], "object_id string, content binary")
    assert sorted(r.name for r in scan.body_hits(df, sigs, "object_id").collect()) == ["Ep", "Last", "Sec"]


def test_container(spark, tmp_path):
    packed = container.pack(members(**{"skip.cbc": "x"}), version=9, time="15 Jul 2026 10:45 +0000", stime=5)
    header = container.parse_header(packed)
    assert (header.version, header.time, header.stime) == (9, "15 Jul 2026 10:45 +0000", 5) and container.parse_header(header.to_bytes()) == header
    container.verify(packed, header, "integrity")
    for bad in (packed[:-1] + b"x", packed[:600]):
        with pytest.raises(container.ContainerError):
            container.verify(bad, header, "integrity")
    with pytest.raises(container.ContainerError):
        container.verify(packed, header, "official")
    df = spark.createDataFrame([("a", bytearray(packed)), ("b", bytearray(b"\0" * 10)), ("c", None)], "db string, content binary")
    rows = container.members(df).collect()
    assert [r.member for r in rows if r.db == "a"] == [k for k in FILES if k[:5] == "daily" and k[-1] != "u"] and all(r.error for r in rows if r.db != "a")
    found = container.checked(df.filter("db = 'a'")).first()
    assert found.intact and found.header_time == header.time and found.header_version == 9 and found.header_stime == 5
    (tmp_path / "daily.cvd").write_bytes(packed)
    (tmp_path / "daily.cvd.tmp").write_bytes(b"x")
    (tmp_path / "README.txt").write_text("x")
    (tmp_path / "z.hdb").write_text("1" * 32 + ":*:Loose\n")
    sigs = directory.load(spark, str(tmp_path), mode="integrity")
    assert scanned(spark, sigs, SAMPLE)[0][1] == "Test.Sha" and sigs.counters().first().file_hash == 4
    assert sigs.database_info(spark).first().version == 9 and sigs.database_info(spark).first().name == "daily"
    assert directory.load_or_empty(spark, str(tmp_path)).counters().first().file_hash == 0  # unsigned


def test_signatures_of_containers():
    p, q = (1 << 521) - 1, (1 << 607) - 1
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    digest = hashlib.md5(b"body")
    signed = container.sign_md5(digest.digest(), d, n)
    assert container.signed_md5(digest.hexdigest(), signed, e, n) and not container.signed_md5("0" * 32, signed, e, n)
    assert container.radix64_decode(container.radix64_encode(12345678901234567890)) == 12345678901234567890 and container.radix64_decode("-") is None
    p, q = (1 << 1279) - 1, (1 << 2203) - 1
    sha, salt = hashlib.sha256(b"body").digest(), bytes(range(32))
    h = hashlib.sha256(bytes(8) + sha + salt).digest()
    plain = (bytes(190) + b"\x01" + salt).rjust(223, b"\0")
    mask = b"".join(hashlib.sha256(h + i.to_bytes(4, "big")).digest() for i in range(7))[:223]
    block = bytes(a ^ b for a, b in zip(plain, mask, strict=True))
    block = bytes([block[0] & 0x7F]) + block[1:] + h + b"\xbc"
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    signed = container.radix64_encode(pow(int.from_bytes(block, "big"), d, n))
    assert container.signed_pss(sha, signed, e, n) and not container.signed_pss(bytes(32), signed, e, n)


def test_limits_and_formats(spark):
    rows = spark.createDataFrame([("a", bytearray(64)), ("b", bytearray(4))], "object_id string, content binary")
    got = {r.object_id: r for r in scan.verdict(objects.limited(rows, 8), SignatureSet.empty(spark)).collect()}
    assert "too large" in got["a"].error and got["a"].result is None and got["b"].result == "clean"
    one = spark.range(1).select(digests.format_bytes(F.lit(1536)).alias("a"), digests.format_bytes(F.lit(3 << 20), 2).alias("b"), digests.format_duration_us(F.lit(1500)).alias("c"), digests.format_unix(F.lit(0)).alias("d"), digests.format_unix(F.lit(60)).alias("e")).first()
    assert tuple(one) == ("1.5 KiB", "3.00 MiB", "1.50 ms", "unknown", "1970-01-01 00:01:00 UTC")


def test_shards(spark, monkeypatch):
    from sievework.operators import sigset

    sigs = directory.load_unpacked(spark, members())
    want = scanned(spark, sigs, SAMPLE + b" ", b"xAAAAyBBBB", b"no")
    monkeypatch.setattr(sigset, "SHARD_BYTES", 1)
    assert len(sigs.shards()) == 4 and scanned(spark, sigs, SAMPLE + b" ", b"xAAAAyBBBB", b"no") == want


def test_repeated_rows(spark, monkeypatch):
    """Equal objects keep a row each, with one shard of rules or several."""
    from sievework.operators import sigset

    rules = [parse.body_rule(f"R.{i}:0:*:{bytes([65 + i] * 4).hex()}") for i in range(3)]
    none = SignatureSet.empty(spark)
    sigs = SignatureSet(none.file_hashes, none.section_hashes, none.allow, none.ignored, tuple(rules))
    rows = spark.createDataFrame([("a", bytearray(b"xBBBBy")), ("a", bytearray(b"xBBBBy")), ("b", None), ("b", None)], "object_id string, content binary")
    for size in (sigset.SHARD_BYTES, 1):
        monkeypatch.setattr(sigset, "SHARD_BYTES", size)
        got = scan.body_scan(rows, sigs, "object_id").collect()
        assert sorted((r.object_id, r.body_name) for r in got if r.body_name) == [("a", "R.1")] * 2 and len(got) == 4


def test_stream_and_publisher(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(SAMPLE)
    snapshots = Snapshots(SignatureSet.empty(spark))
    held = snapshots.current()
    versions = {"main": container.pack(members(), version=1)}
    settings = Settings.from_map({"db_dir": str(tmp_path / "db"), "update_seconds": "5", "skip_signature": "1", "databases": "main,gone"})
    assert settings.update_seconds == 30

    def mirror(name, header_only):
        if name not in versions:
            raise OSError("none")
        return versions[name][: container.HEADER] if header_only else versions[name]

    publisher = Publisher(spark, settings, [mirror], lambda: directory.load(spark, settings.db_dir, mode="integrity"), snapshots)
    assert publisher.tick() and not publisher.tick() and "gone" in publisher.failures
    assert snapshots.current() is not held and scanned(spark, held, SAMPLE)[0][0] == "clean"
    out = []
    stream = objects.stream_files(spark, str(tmp_path / "in"))
    scan_stream(stream, snapshots, lambda rows, n: out.extend(rows.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [(r.result, r.signature) for r in out] == [("infected", "Test.Sha")]
    a = container.parse_header(versions["main"])
    assert stale(None, a) and not stale(a, a) and not stale(a, None)
