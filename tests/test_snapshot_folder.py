"""Snapshot folders: what the manifest vouches for becomes pages, the rest is held back with its reason."""

import hashlib
import json

from hushpage.sources.snapshot_folder import read_snapshot_folder


def page(n):
    return json.dumps({"elements": [{"id": f"e{n}_{i}", "type": "text", "text": "t", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}} for i in range(n)], "documentWidth": 9})


def folder(path, files, sums=None, extra=()):
    (path / "more").mkdir(parents=True)
    for name, text in files.items():
        (path / name).write_text(text)
    listed = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files.items()} | (sums or {})
    (path / "manifest.json").write_text(json.dumps({"files": [{"name": n, "sha256": s} for n, s in listed.items() if n not in extra]}))


def test_only_files_with_the_right_sum_become_pages(spark, tmp_path):
    files = {"a.json": page(2), "more/b.json": page(3), "bad.json": page(4), "no.json": "[1", "large.json": page(40), "extra.json": page(1)}
    folder(tmp_path / "in", files, {"bad.json": "0" * 64, "gone.json": "1" * 64}, ("extra.json",))
    for together in (1, 4):
        elements, held = read_snapshot_folder(spark, str(tmp_path / "in"), filesPerTask=together, mostBytes=2_000)
        assert sorted((r.source, r.ord, r.id, r.width) for r in elements.collect()) == [("a.json", i, f"e2_{i}", 3.0) for i in range(2)] + [("more/b.json", i, f"e3_{i}", 3.0) for i in range(3)]
        want = {"bad.json": "WRONG_CHECKSUM", "no.json": "MALFORMED", "large.json": "TOO_LARGE", "extra.json": "UNLISTED", "gone.json": "MISSING"}
        assert {r.file: r.error for r in held.collect()} == want
        assert elements.rdd.getNumPartitions() == (7 if together == 1 else 2)


def test_a_file_that_changes_after_planning_is_caught(spark, tmp_path):
    folder(tmp_path / "in", {"a.json": page(1)})
    elements, held = read_snapshot_folder(spark, "file://" + str(tmp_path / "in"))
    assert elements.count() == 1 and held.count() == 0
    (tmp_path / "in/a.json").write_text(page(2))
    assert elements.count() == 0 and held.first().error == "WRONG_CHECKSUM"


def test_an_empty_manifest(spark, tmp_path):
    folder(tmp_path / "in", {})
    elements, held = read_snapshot_folder(spark, str(tmp_path / "in"))
    assert elements.count() == held.count() == 0
