"""Zip archives."""

import random
import zipfile

import pytest

from quarry.plans import analyze
from quarry.sources import archives


def pack(path, entries, comment=b"", **more):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, *attributes in entries:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            info.external_attr = (attributes[0] if attributes else 0o100644) << 16
            z.writestr(info, data)
        z.comment = comment
    return str(path)


def test_entries_equal_those_of_the_library(spark, tmp_path):
    r = random.Random(1)
    packed = []
    for k in range(5):
        own = [("top/", b"", 0o40755)] + [(f"top/d{r.randrange(3)}/f{n}.py", r.randbytes(r.randrange(5000))) for n in range(40)]
        packed.append(pack(tmp_path / f"{k}.zip", own, comment=b"c" * k * 100))
    files, refused = archives.unpack(spark, packed)
    assert refused.count() == 0
    got = {(r.archive_id, r.relative_path): bytes(r.content) for r in files.collect()}
    want = {}
    for p in packed:
        with zipfile.ZipFile(p) as z:
            want |= {(p, i.filename.removeprefix("top/")): z.read(i) for i in z.infolist() if not i.is_dir()}
    assert got == want


BAD = {
    "ratio": ([("t/a", b"0" * (5 << 20))], "compression ratio"), "link": ([("t/a", b"x"), ("t/l", b"a", 0o120777)], "link or special file"), "deep": ([("t/" * 200 + "a", b"x")], "too deep"),
    "twice": ([("t/a", b"x"), ("t/a", b"y")], "duplicate"), "roots": ([("t/a", b"x"), ("u/a", b"y")], "more than one top-level folder"), "up": ([("t/../../a", b"x")], "dot component"), "absolute": ([("/t/a", b"x")], "absolute"),
    "long": ([("t/" + "x" * 5000, b"x")], "name too long"), "bare": ([("a", b"x")], "the top is no folder"), "none": ([("t/", b"", 0o40755)], "no files"), "drive": ([("c:/a", b"x")], "drive"),
}


def test_bad_archives_are_refused_before_they_are_unpacked(spark, tmp_path, monkeypatch):
    good = pack(tmp_path / "good.zip", [("t/a", b"x")])
    packed = {name: pack(tmp_path / f"{name}.zip", own) for name, (own, _) in BAD.items()}
    broken = {"text": b"nothing", "empty": b"", "cut": (tmp_path / "good.zip").read_bytes()[:-10], "two": (tmp_path / "good.zip").read_bytes()[:-2] + b"\x16\0" + b"PK\x05\x06" + bytes(18), "disks": (tmp_path / "good.zip").read_bytes()[:-18] + b"\1\0" + (tmp_path / "good.zip").read_bytes()[-16:]}
    for name, raw in broken.items():
        (tmp_path / f"{name}.zip").write_bytes(raw)
    files, refused = archives.unpack(spark, [good, *packed.values(), *(str(tmp_path / f"{n}.zip") for n in broken), str(tmp_path / "absent.zip")])
    assert [(r.archive_id, r.relative_path, bytes(r.content)) for r in files.collect()] == [(good, "a", b"x")]
    why = {}
    for r in refused.collect():
        why.setdefault(r.archive_id.rpartition("/")[2][:-4], set()).add(r.problem)
    assert {k: v for k, v in why.items() if k in BAD} == {k: {p} for k, (_, p) in BAD.items()}
    assert why["two"] == {"two footers"} and why["disks"] == {"spans several disks"} and why["text"] == why["empty"] == why["cut"] == {"no footer"} and len(why["absent"]) == 1


def test_a_lying_size_is_told(spark, tmp_path):
    path = pack(tmp_path / "a.zip", [("t/a", b"x" * 100), ("t/b", b"y")])
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    at = raw.index(b"PK\x01\x02")
    raw[at + 24 : at + 28] = (50).to_bytes(4, "little")
    (tmp_path / "a.zip").write_bytes(raw)
    files, refused = archives.unpack(spark, [path])
    assert files.count() == 0 and [(r.name, r.problem is not None) for r in refused.collect()] == [("a", True)]


def test_review_of_an_archive(spark, tmp_path):
    path = pack(tmp_path / "r.zip", [("repo-1/a.py", b"x = 1\n# TODO one\n# TODO two\n"), ("repo-1/bin.py", b"\0# TODO"), ("repo-1/.gitignore", b"a.py\n"), ("repo-1/node_modules/x.py", b"# TODO")])
    text = "--- a/a.py\n+++ b/a.py\n@@ -1 +3 @@\n+# TODO two\n--- a/node_modules/x.py\n+++ b/node_modules/x.py\n@@ -0,0 +1 @@\n+# TODO\n"
    got = analyze.review_archive(spark, path, text)
    assert [(r.id, r.file, r.line_start) for r in got.findings.collect()] == [("QUAL-001", "a.py", 3)]
    with pytest.raises(ValueError, match="link or special file"):
        analyze.review_archive(spark, pack(tmp_path / "b.zip", BAD["link"][0]), text)
