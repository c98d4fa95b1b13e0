"""The frozen vault: parsing, and the published retrieval scores."""

import pytest

from marginalia.config import Search, sweep, with_override
from marginalia.jobs import notes
from marginalia.jobs import retrieve as job
from marginalia.operators import bench, graph
from marginalia.sources import vault

NOTES = {
    "deploy-container.md": '---\nid: deploy-container\ntitle: "Deploying with a container image"\ntopic: deploy\n---\n\n# Deploying with a container image {#root}\n\nBuild an image, push it, and roll it out. This is the current process.\n',
    "deploy-rsync.md": '---\nid: deploy-rsync\ntitle: "Deploying with rsync"\nstatus: obsolete\ntopic: deploy\n---\n\n# Deploying with rsync {#root}\n\nsupersedes:: [[deploy-container#root]]\n\nPush built assets straight over rsync. Replaced by the container rollout.\n',
    "obs-cursor-follow.md": '---\nid: obs-follow\ntitle: "OBS cursor follow"\ntopic: obs\n---\n\n# OBS cursor follow {#root}\n\nCrop the capture to a region that tracks the pointer.\n\n## Smoothing the crop {#smoothing}\n\ncontradicts:: [[obs-follow#naive]]\n\nApply exponential damping to the target rectangle, then update the transform once per\nframe. Without damping the view snaps and reads as broken.\n\n## The naive version {#naive}\n\nMove the crop rectangle straight to the pointer on every frame. This jitters badly.\n',
    "pg-backup.md": '---\nid: pg-backup\ntitle: "Nightly Postgres dump to S3"\ntopic: postgres\n---\n\n# Nightly Postgres dump to S3 {#root}\n\nrelated:: [[restic-backup#root]]\n\nA cron job dumps the database and uploads it to a versioned bucket.\n\n## Retention {#retention}\n\nKeep fourteen dailies and eight weeklies, pruned by a lifecycle rule.\n',
    "restic-backup.md": '---\nid: restic-backup\ntitle: "Encrypted incremental backups with restic"\ntopic: backup\n---\n\n# Encrypted incremental backups with restic {#root}\n\nRestic snapshots the home directory to Backblaze B2, deduplicated and encrypted.\n',
    "wireguard.md": '---\nid: wireguard\ntitle: "Raw WireGuard without a coordinator"\ntopic: network\n---\n\n# Raw WireGuard without a coordinator {#root}\n\nHand-written peer configuration, no control plane.\n\n## Key exchange {#keys}\n\nGenerate a private key per peer and exchange only the public halves.\n',
}
QUESTIONS = [
    ("how do I stop the OBS crop from jittering?", ["obs-follow#smoothing"]),
    ("obs cursor follow", ["obs-follow#root", "obs-follow#smoothing"]),
    ("how do I schedule a nightly postgres backup?", ["pg-backup#root"]),
    ("how long are backups kept?", ["pg-backup#retention"]),
    ("wireguard without a coordinator", ["wireguard#root"]),
    ("how do I deploy?", ["deploy-container#root"]),
]


@pytest.fixture(scope="module")
def frozen(spark):
    notes = spark.createDataFrame(list(NOTES.items()), "path string, content string")
    sections = vault.sections(notes).cache()
    questions = spark.createDataFrame([(i, q, e) for i, (q, e) in enumerate(QUESTIONS)], "qid long, question string, expected array<string>")
    return sections, vault.edges(sections).cache(), questions


def test_parsing(frozen):
    sections, edges, _ = frozen
    rows = {r.section_uid: r for r in sections.collect()}
    assert len(rows) == 10
    assert rows["obs-follow#smoothing"].heading_path == "OBS cursor follow > Smoothing the crop"
    assert rows["obs-follow#naive"].parent_uid == "obs-follow#root" and rows["deploy-rsync#root"].status == "obsolete"
    found = {(e.src, e.dst, e.relation) for e in edges.collect()}
    assert {e for e in found if e[2] != "parent"} == {("obs-follow#smoothing", "obs-follow#naive", "contradicts"), ("pg-backup#root", "restic-backup#root", "related"), ("deploy-rsync#root", "deploy-container#root", "supersedes")}
    assert sum(e[2] == "parent" for e in found) == 4
    assert [(r.a, r.b) for r in graph.contradictions(edges).collect()] == [("obs-follow#naive", "obs-follow#smoothing")]
    assert graph.unresolved_contradictions(edges, sections).count() == 1


@pytest.mark.parametrize("overrides, expected", [({}, [1, 1, 1, 3, 1, 1]), ({"graph.min_weight": "0.1"}, [1, 1, 1, None, 1, 1]), ({"graph.enabled": "false"}, [1, 1, 1, None, 1, 1])])
def test_published_ranks(frozen, overrides, expected):
    config = Search()
    for key, value in overrides.items():
        config = with_override(config, key, value)
    ranks = bench.ranks(frozen[2], job.retrieve(*frozen, config)).orderBy("qid")
    assert [r.rank for r in ranks.collect()] == expected


def test_sweep_lifts_recall(frozen):
    rows = job.benchmark(*frozen, sweep(["graph.min_weight=0.1,0.05"])).orderBy("combo").collect()
    assert [round(r.recall_3, 2) for r in rows] == [0.83, 1.0] and [round(r.mrr, 2) for r in rows] == [0.83, 0.89]


def test_no_prefix_misses_deploy(frozen):
    ranks = bench.ranks(frozen[2], job.retrieve(*frozen, prefix_last=False)).orderBy("qid")
    assert [r.rank for r in ranks.collect()][5] is None


def test_prompts(frozen):
    sections, edges, questions = frozen
    rows = job.retrieve(sections, edges, questions)
    out = {r.qid: r for r in job.prompts(rows, questions, 600).collect()}
    assert len(out) == 6 and out[1].prompt.startswith("<source 1>\npath: obs-cursor-follow.md\nheading: ") and out[1].prompt.endswith("Question: obs cursor follow")


def test_unsearchable(frozen, spark):
    sections, edges, _ = frozen
    for text in ("", "   ", "--", '""""', "how do I"):
        assert job.retrieve(sections, edges, spark.createDataFrame([(1, text)], "qid long, question string")).count() == 0


def test_scan_follows_a_folder(spark, tmp_path):
    """Sizes and times are looked at before hashes; a broken file is a row, and a failed scan leaves the notes before."""
    root, store = tmp_path / "vault", str(tmp_path / "store")
    (root / "deep").mkdir(parents=True)
    write = lambda name, text: (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    for name, text in NOTES.items():
        write(name, text)
    write("deep/x.md", "# X {#x}\n\nalpha")
    write("deep/skipped.md", "# S")
    write("other.txt", "no note")
    scan = lambda: notes.scan(spark, str(root), store, exclude=["**/skipped.md"])
    uids = lambda n: sorted(r.section_uid for r in n.sections.collect())
    at, summary = scan()
    assert tuple(summary.first()) == (7, 0, 0, 0) and len(uids(at)) == 11 and at.generation == 1
    assert {r.path for r in at.files.collect()} == {*NOTES, "deep/x.md"}
    at, summary = scan()
    assert tuple(summary.first()) == (0, 7, 0, 0) and len(uids(at)) == 11
    kept = {r.bucket: r.version for r in at.versions.collect()}
    write("wireguard.md", b"# Raw \xff\xfe")
    write("deep/x.md", "# X {#x}\n\nbeta\n# Y {#y}\n\ngamma")
    write("pg-backup.md", NOTES["pg-backup.md"])
    (root / "deploy-rsync.md").unlink()
    write("new.md", "# New {#n}\n\ndelta")
    at, summary = scan()
    assert tuple(summary.first()) == (2, 4, 1, 1) and at.generation == 3
    assert "x#y" in uids(at) and "new#n" in uids(at) and "deploy-rsync#root" not in uids(at) and "wireguard#root" in uids(at)
    assert [(r.path, r.failed) for r in at.files.filter("failed IS NOT NULL").collect()] == [("wireguard.md", "it is no UTF-8")]
    now = {r.bucket: r.version for r in at.versions.collect()}
    assert sum(now[b] == kept[b] for b in now if b in kept) >= len(kept) - 3
    write("wireguard.md", NOTES["wireguard.md"])
    at, summary = scan()
    assert tuple(summary.first()) == (0, 7, 0, 0) and at.files.filter("failed IS NOT NULL").isEmpty()
    write("new.md", "# New {#n}\n\nepsilon")
    parse = vault.sections
    try:
        vault.sections = lambda rows: 1 / 0
        with pytest.raises(ZeroDivisionError):
            scan()
    finally:
        vault.sections = parse
    assert notes.latest(spark, store).generation == 4 and uids(notes.latest(spark, store)) == uids(at)
    assert tuple(scan()[1].first()) == (1, 6, 0, 0)
