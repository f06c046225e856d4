"""Histories on two levels against loops over whole histories."""

import random
import re

import pytest

from evidentia.operators import history as H
from evidentia.operators.tables import Folder
from evidentia.sources import gitlog

COMMITS = "repo_id int, hash string, ts long, author string, subject string, added long, removed long, files int, paste_pos int"


def made():
    random.seed(7)
    rows = []
    for repo, n, timed in ((1, 240, True), (2, 3, True), (3, 60, False), (4, 90, True), (5, 1, True)):
        t = 1_600_000_000
        for k in range(n):
            t += random.choice([0, 0, 60, 400, 1200, 90_000])
            subject = random.choice(["Add a thing", "fix typo", "fix import path", "oops", "update", "PROJ-12 done", "Merge x", None, "Create payment api component using oauth and jwt tokens for routing"])
            added = random.choice([0, 3, 8, 9, 250, 500]) if repo != 3 else 0
            if 50 <= k < 54:  # a trail, in which no time is the same
                t, subject, added = t + 1, ("Add a thing", "fix typo", "oops", "fix import path")[k - 50], (500 if k == 50 else k % 8) if repo != 3 else 0
            rows.append((repo, f"{random.getrandbits(60):015x}", t if timed else 0, random.choice(["Ann", "ann", "Bob", ""]), subject, added, 0, 2, n - k))
    rows += [(4, "f" * 15, None, "Ann", "late, without a time", 5, 0, 1, 0)]
    return rows


def ordered(rows, repo):
    mine = [r for r in rows if r[0] == repo]
    if any((r[2] or 0) > 0 for r in mine):
        return sorted(mine, key=lambda r: (r[2] or 0, r[1], -r[8]))
    return sorted(mine, key=lambda r: -r[8])


@pytest.mark.parametrize("block", [10, 100_000])
def test_blocks_give_what_loops_over_whole_histories_give(spark, block):
    rows = made()
    folder = Folder(spark, "history")
    placed = H.position(spark.createDataFrame(rows, COMMITS), folder, block)
    got = {(r["repo_id"], r["pos"]): r["hash"] for r in placed.collect()}
    whole = {repo: ordered(rows, repo) for repo in {r[0] for r in rows}}
    assert got == {(repo, i): c[1] for repo, mine in whole.items() for i, c in enumerate(mine)}
    found = H.bursts(placed, folder, block)
    burst = {(r["repo_id"], r["pos"]): (r["lines"], r["commits"]) for r in found.collect()}
    expected = {}
    for repo, mine in whole.items():
        for i, c in enumerate(mine):
            if (c[2] or 0) > 0:
                inside = [x for x in mine[i:] if x[2] - c[2] <= 1200]
                expected[repo, i] = (sum(x[5] for x in inside), len(inside))
    assert burst == expected
    is_fix = lambda c: bool(re.search(H.FIX, c[4] or "") or re.search(H.TINY, c[4] or "")) and c[5] <= 8
    trail = {}
    for repo, mine in whole.items():
        counts = any(c[5] + c[6] > 0 for c in mine)
        starts = [i for i, c in enumerate(mine) if (c[5] >= 200 if counts else re.search(H.CREATE, c[4] or "")) and len(mine) > i + 3 and all(map(is_fix, mine[i + 1 : i + 4]))]
        trail[repo] = starts
    f = H.features(placed, found)
    features = {r["repo_id"]: r for r in f.collect()}
    assert {repo: r["trail"] for repo, r in features.items()} == {repo: bool(s) for repo, s in trail.items()} and trail[1] and trail[3]
    assert {repo: r["burst"] for repo, r in features.items()} == {repo: any(b[0] >= 400 and b[1] >= 2 for (x, _), b in expected.items() if x == repo) for repo in whole}
    # evidence: bursts that don't overlap, and the first trail
    shown = {(r["repo_id"], r["signal_id"]): r["evidence"] for r in H.evidence(placed, found, f).collect()}
    i, at, lines = 0, [], []
    mine = whole[1]
    while i < len(mine):
        b = expected[1, i]
        if b[0] >= 400 and b[1] >= 2:
            at.append(i)
            j = i + b[1]
            minutes = max(1, int((mine[min(j, len(mine) - 1)][2] - mine[i][2]) / 60 + 0.5))
            lines.append(f"{b[0]:,} lines across {b[1]} commits in about {minutes} minute{'' if minutes == 1 else 's'}")
            i = j
        else:
            i += 1
    assert shown[1, "gh.velocity"] == list(dict.fromkeys(lines[:3]))
    s = trail[1][0]
    assert shown[1, "gh.micro_fix_trail"] == list(dict.fromkeys([f"after a commit of +{mine[s][5]:,} lines:"] + [f'"{c[4]}" (+{c[5]})' for c in mine[s + 1 : s + 4]]))
    assert shown[3, "gh.micro_fix_trail"][0] == "after a commit of +0 lines:" and all("fired" not in line for e in shown.values() for line in e) and all(1 <= len(e) <= 4 for e in shown.values())
    notes = {r["repo_id"]: r["notes"] for r in H.notes(f).collect()}
    assert notes[3] == ["no_line_counts", "no_times", "shape_of_the_work"] and notes[2] == ["thin", "shape_of_the_work"]
    folder.drop()


def test_log_files_larger_than_a_split(spark, tmp_path):
    """Spark reads the file in splits of a few hundred bytes; commits whose lines lie in two of them stay whole."""
    random.seed(3)
    expected = {}
    for name, n in (("one", 150), ("two", 4), ("none", 0)):
        text = ["a line above all commits", "1\t1\tnobody"] if n else []
        for k in range(n):
            files = [(random.choice([0, 5, 70]), random.randrange(9)) for _ in range(random.choice([0, 1, 12]))]
            text += [f"{k:07x}|{1_600_000_000 + k}|Dev {k % 3}|subject {k}", ""] + [f"{a}\t{r}\tsrc/{i}.txt\r" for i, (a, r) in enumerate(files)]
            expected[name, f"{k:07x}"] = (1_600_000_000 + k, f"Dev {k % 3}", f"subject {k}", sum(a for a, _ in files), sum(r for _, r in files), len(files), k + 1)
        (tmp_path / f"{name}.log").write_text("\n".join(text))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = gitlog.read_lines(spark, str(tmp_path))
        assert lines.select("split").distinct().count() > 10
        got = {(r["log"].rsplit("/", 1)[1][:-4], r["hash"]): tuple(r[c] for c in ("ts", "author", "subject", "added", "removed", "files", "paste_pos")) for r in gitlog.commits_of_lines(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == expected


def test_no_commits(spark):
    folder = Folder(spark, "history")
    placed = H.position(spark.createDataFrame([], COMMITS), folder)
    found = H.bursts(placed, folder)
    f = H.features(placed, found)
    assert placed.count() == 0 and f.count() == 0 and H.evidence(placed, found, f).count() == 0
    folder.drop()
