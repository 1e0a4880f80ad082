"""Entries of test archives: good, damaged, too large, not an archive at all."""

import hashlib
import zipfile

from docprism.sources import archives


def test_entries_of_archives(spark, tmp_path):
    files = {"a/g1__plain.pdf": b"%PDF-1.7 one", "a/g1__hit__white.pdf": b"%PDF-1.7 two", "b/g2__plain.txt": b"text", "b/odd name.pdf": b"%PDF-", "b/g3__plain.pdf": b"%PDF-" + bytes(range(256)) * 40, "empty__file.pdf": b""}
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("a")
        for name, content in files.items():
            z.writestr(name, content)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("g4__plain.pdf", b"%PDF- stored and then damaged")
        z.writestr("g5__plain.pdf", b"%PDF- good")
        z.writestr("g1__plain.pdf", b"x" * 50_000)
    raw = bytearray((tmp_path / "two.zip").read_bytes())
    at = raw.index(b"stored and then")
    raw[at : at + 6] = b"STORED"
    (tmp_path / "two.zip").write_bytes(raw)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "ignored.txt").write_bytes(b"other")

    rows = archives.named(archives.entries(spark, str(tmp_path), 20_000)).cache()
    got = {(r.archive, r.entry): r for r in rows.collect()}
    assert len(got) == len(files) + 4
    for name, content in files.items():
        r, sha = got["one.zip", name], hashlib.sha256(content).hexdigest()
        assert (r.size, r.sha256, r.address, r.error) == (len(content), sha, f"{sha[:2]}/{sha}", None)
        assert r.signature == ("pdf" if content.startswith(b"%PDF-") else "other")
    assert got["two.zip", "g4__plain.pdf"].error == "damaged: BadZipFile" and got["two.zip", "g4__plain.pdf"].sha256 is None
    assert got["two.zip", "g5__plain.pdf"].error is None and got["two.zip", "g1__plain.pdf"].error == "too_large"
    assert got["broken.zip", None].error == "not an archive: BadZipFile"
    r = got["one.zip", "a/g1__hit__white.pdf"]
    assert (r.group, r.variant, r.attack) == ("g1", "hit", "white") and got["one.zip", "b/odd name.pdf"].group is None

    expected = spark.createDataFrame([("g1", "plain", None), ("g1", "hit", "white"), ("g2", "plain", None), ("g9", "plain", None), ("g5", "plain", None)], "group string, variant string, attack string")
    state = {(r.group, r.variant, r.attack): r.state for r in archives.reconciled(rows.where("group is not null"), expected).collect()}
    assert state == {
        ("g1", "plain", None): "repeated", ("g1", "hit", "white"): "ok", ("g2", "plain", None): "ok", ("g3", "plain", None): "unexpected", ("g4", "plain", None): "unexpected", ("g5", "plain", None): "ok",
        ("g9", "plain", None): "missing", ("empty", "file", None): "unexpected",
    }
