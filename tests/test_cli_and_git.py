import json
import os
import subprocess

import pytest

from millrace import cli
from millrace import settings as C
from millrace.functions import text as X
from millrace.operators import hashlist
from millrace.operators import references as R
from millrace.sources import git

ENV = os.environ | {
    "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x.example", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x.example",
    "GIT_AUTHOR_DATE": "2024-01-02T03:04:05+0000", "GIT_COMMITTER_DATE": "2024-01-02T03:04:05+0000", "GIT_CONFIG_GLOBAL": "/dev/null",
}


def run(folder, *args, data=None):
    return subprocess.run(["git", *args], cwd=folder, env=ENV, input=data, capture_output=True, check=True).stdout.decode().strip()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repo")
    run(folder, "init", "-q", "-b", "main")
    hashes = []
    for name, text, message in (("arch/mm.c", "one\n", "mm: fix it\n\nBody é\r\nmore\n"), ("net/ü.c", "two\n", "net: lock order"), ("arch/mm.c", "three\n" * 40, "mm: revert\n")):
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text)
        run(folder, "add", "-A")
        run(folder, "commit", "-q", "--cleanup=verbatim", "-F", "-", data=message.encode())
        hashes.append(run(folder, "rev-parse", "HEAD"))
    return folder, hashes


def archive(root, epoch, mails):
    bare = root / "git" / f"{epoch}.git"
    work = root / f"work{epoch}"
    work.mkdir(parents=True)
    run(work, "init", "-q", "-b", "main")
    for i, data in enumerate(mails):
        if data is None:
            (work / "m").unlink(missing_ok=True)
            (work / "d").write_text(str(i))
        else:
            (work / "m").write_bytes(data)
        run(work, "add", "-A")
        run(work, "commit", "-q", "-m", str(i))
    bare.parent.mkdir(exist_ok=True)
    run(root, "clone", "-q", "--bare", str(work), str(bare))


@pytest.fixture(scope="module")
def inbox(tmp_path_factory, repo):
    root = tmp_path_factory.mktemp("inbox")
    one = f"Subject: CVE-2024-0001\nMessage-ID: <1@x>\n\nfixed in 6.1 with commit {repo[1][0][:12]}\nfixed in 6.2 with commit {'9' * 12}\n".encode()
    two = f"From x\nSubject: CVE-2024-0002\nMessage-ID: <2@x>\n\nhttps://git.kernel.org/stable/c/{repo[1][1]}\n".encode()
    archive(root, 0, [one, None])
    archive(root, 2, [two, one.replace(b"<1@x>", b"<1@X>")])
    archive(root, 10, [b"Subject: hello\n\nno id"])
    return root


def test_epochs_and_messages(spark, inbox):
    assert [n for n, _ in git.epochs(inbox)] == [0, 2, 10] == [n for n, _ in git.epochs(inbox / "git")]
    assert [n for n, _ in git.epochs(inbox / "git" / "2.git")] == [2]
    with pytest.raises(git.GitError):
        git.epochs(inbox / "work0")
    df = git.read_archive(spark, str(inbox))
    assert [(r.epoch, r.seq) for r in df.orderBy("epoch", "seq").collect()] == [(0, 0), (2, 0), (2, 1), (10, 0)]
    assert [r.epoch for r in df.where("epoch = 10").collect()] == [10]


def test_commits(spark, repo):
    folder, hashes = repo
    asked = spark.createDataFrame([(0, hashes[0][:8].upper()), (1, "f" * 40), (2, hashes[2]), (3, "HEAD")], "input_index long, requested_hash string")
    rows = git.read_commits(asked, str(folder), max_diff_chars=120).orderBy("input_index").collect()
    assert (rows[0].hash, rows[0].subject, rows[0].body, rows[0].files, rows[0].author, rows[0].date) == (hashes[0], "mm: fix it", "Body é\nmore", ["arch/mm.c"], "A", "2024-01-02")
    assert rows[0].diff.startswith("diff --git") and rows[0].original_diff_chars > 120 and rows[0].diff_truncated and len(rows[0].diff) == 120
    assert rows[1].error and rows[1].hash == "f" * 40 and rows[3].error and not rows[2].error
    bare = git.read_commits(asked, str(folder), with_diff=False).orderBy("input_index").first()
    assert bare.diff == "" and bare.original_diff_chars == 0
    git.register(spark)
    read = spark.read.format("git_commits").option("hashes", f"{hashes[1]},{hashes[0]}").option("batch", "1").load(str(folder))
    assert {r.hash: r.files for r in read.collect()} == {hashes[1]: ['"net/\\303\\274.c"'], hashes[0]: ["arch/mm.c"]}
    with pytest.raises(git.GitError):
        git.check_work_tree(folder / "none")


def test_stages_end_to_end(spark, repo, inbox, tmp_path, capsys):
    folder, hashes = repo
    (tmp_path / "context.md").write_text("what we look for")
    (tmp_path / "evidence").mkdir()
    (tmp_path / "evidence" / f"{hashes[0]}.md").write_text("seen on a board")
    toml = tmp_path / "s.toml"
    toml.write_text(
        f'linux_dir = "{folder}"\nhashes_file = "kept.txt"\noutdir = "out"\ncontext_md = "context.md"\nevidence_dir = "evidence"\nworkers = 2\n'
        f'[hash_filter]\nsource_file = "candidates.txt"\ninclude = ["fix", "lock"]\n[cve_source]\ninbox_dir = "{inbox}"\n'
    )
    args = ["--settings", str(toml)]
    assert cli.main(["extract", *args], spark) == 0
    assert (tmp_path / "candidates.txt").read_text().split() == hashes[:2]
    audit = [json.loads(x) for x in (tmp_path / "candidates.txt.audit.jsonl").read_text().splitlines()]
    assert [a["status"] for a in audit] == ["selected", "selected", "ignored"] and audit[0]["fixes"][1]["in_linux_repo"] is False

    (tmp_path / "candidates.txt").write_text(f"{hashes[0][:9]}\n{hashes[2]}\n{hashes[0]}\n")
    assert cli.main(["filter", *args], spark) == 0
    assert (tmp_path / "kept.txt").read_text().split() == [hashes[0], hashes[0]]  # two spellings of one commit
    assert cli.main(["filter", *args, "--include", "revert"], spark) == 0
    assert (tmp_path / "kept.txt").read_text().split() == [hashes[2]]
    (tmp_path / "candidates.txt").write_text(f"{hashes[1]}\n{'f' * 40}\n")
    assert cli.main(["filter", *args], spark) == 1

    (tmp_path / "kept.txt").write_text(f"{hashes[0][:9]}\n{hashes[1]}\n{hashes[0]}\n{'e' * 40}\n")
    assert cli.main(["analyze", *args, "--end-index", "0"], spark) == 0 and not (tmp_path / "out").exists()
    log = tmp_path / "calls"
    assert cli.main(["analyze", *args], spark, make_model=Counting(str(log))) == 1
    assert sorted(log.read_text().split()) == sorted([hashes[0], hashes[1]])
    report = (tmp_path / "out" / f"{hashes[0]}.md").read_text()
    assert report.startswith(X.SUCCESS_MARK) and "evidence True" in report
    index = (tmp_path / "out" / "index.md").read_text().splitlines()[2:]
    assert [line.split("]")[0][3:] for line in index] == [hashes[0], hashes[1], hashes[0], "e" * 40] and "failed" in index[3]
    assert cli.main(["analyze", *args], spark, make_model=Counting(str(log))) == 1
    assert len(log.read_text().split()) == 2  # finished reports aren't asked for again
    assert cli.main(["analyze", *args, "--force", "--end-index", "2"], spark, make_model=Counting(str(log))) == 0
    assert len(log.read_text().split()) == 4
    (tmp_path / "kept.txt").write_text("HEAD\n")
    assert cli.main(["analyze", *args], spark) == 2 and cli.main(["filter", *args, "--include", "["], spark) == 2 and cli.main([], spark) == 2
    assert "not a hash" in capsys.readouterr().err


class Counting:
    """Makes models that note which commits they were asked about; ``last`` calls kill the process."""

    def __init__(self, log, last=10**9):
        self.log, self.last = log, last

    def __call__(self):
        return self.ask

    def ask(self, task):
        if os.path.exists(self.log) and len(open(self.log).read().split()) >= self.last:
            os._exit(1)
        with open(self.log, "a") as out:
            out.write(task.split("\ncommit: ")[1].split("\n")[0] + "\n")
        return f"evidence {'seen on a board' in task}"


def test_a_killed_job_pays_for_no_answer_twice(spark, repo, tmp_path):
    folder, hashes = repo
    (tmp_path / "context.md").write_text("what we look for")
    (tmp_path / "list.txt").write_text("\n".join(hashes) + "\n")
    args = ["analyze", str(folder), str(tmp_path / "list.txt"), "--context-md", str(tmp_path / "context.md"), "--outdir", str(tmp_path / "out"), "--workers", "1"]
    log = tmp_path / "calls"
    with pytest.raises(Exception, match="Python worker"):
        cli.main(args, spark, make_model=Counting(str(log), 2))
    assert len(log.read_text().split()) == 2 and len(list((tmp_path / "out").glob("*.md"))) == 2
    assert cli.main(args, spark, make_model=Counting(str(log))) == 0
    assert sorted(log.read_text().split()) == sorted(hashes)


def test_references_are_resolved_by_git(spark, tmp_path):
    run(tmp_path, "init", "-q", "-b", "main")
    by_prefix, n = {}, 0
    while True:  # two commits whose hashes begin alike
        made = run(tmp_path, "commit-tree", "4b825dc642cb6eb9a060e54bf8d69288fbee4904", "-m", str(n)) if n else (run(tmp_path, "write-tree"), run(tmp_path, "commit-tree", "4b825dc642cb6eb9a060e54bf8d69288fbee4904", "-m", "0"))[1]
        n += 1
        if made[:4] in by_prefix:
            break
        by_prefix[made[:4]] = made
    one, two = by_prefix[made[:4]], made
    run(tmp_path, "tag", "-a", "-m", "t", "v1", one)
    tag = run(tmp_path, "rev-parse", "v1")
    asked = [made[:4], one, two[:30].upper(), tag, "e" * 40, "HEAD", None]
    found = git.resolve_in_repository(spark.createDataFrame([(a,) for a in asked], "ref string"), "ref", str(tmp_path))
    # the ambiguous prefix stays unresolved although one of its commits is named in full as well
    assert {r.ref: r.canonical_hash for r in found.collect()} == {one: one, two[:30]: two, tag: one}
    fixes = spark.createDataFrame([(1, 0, a) for a in asked if a], "mail int, fix_idx int, reported_hash string")
    got = R.attach(fixes, git.resolve_in_repository(fixes, "reported_hash", str(tmp_path))).collect()
    assert {r.reported_hash: r.canonical_hash for r in got} == {made[:4]: "", one: one, two[:30].upper(): two, tag: one, "e" * 40: "", "HEAD": ""}


def test_hash_lists_keep_their_order_over_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    hashes = [f"{i * 7919 % 1_000_003:08x}" for i in range(20_000)]
    path.write_text("\ufeff# list\r\n" + "".join(f" {h}\x0b\n" if i % 3 else f"{h}\r\n\n" for i, h in enumerate([*hashes, hashes[5].upper()])), newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = hashlist.read_hash_list(spark, str(path)).orderBy("input_index").collect()
        assert [r.requested_hash for r in rows] == list(dict.fromkeys(hashes)) and [r.input_index for r in rows] == list(range(len(rows)))
        path.write_text("abcd\n\n# x\n" * 5000 + "wrong\n")
        with pytest.raises(hashlist.HashListError, match="line 15001: not a hash: 'wrong'"):
            hashlist.read_hash_list(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('outdir = "o"\nworkers = 3\nforce = true\nhashes_file = ""\n[openai]\nmodel = " m "\n[hash_filter]\ninclude = [" a ", ""]\nfields = ["diff"]\nmatch = "all"\n[cve_source]\nfallback_to_all = true\n')
    s = C.load_settings(path)
    assert (s.outdir, s.workers, s.force, s.hashes_file, s.openai.model) == (tmp_path / "o", 3, True, None, "m")
    assert (s.hash_filter.include, s.hash_filter.fields, s.hash_filter.match, s.cve_source.prefer_mainline, s.cve_source.fallback_to_all) == (("a",), ("diff",), "all", True, True)
    for bad in ("worker = 1", "workers = true", "workers = '1'", "force = 1", "openai = 1", "[openai]\nkey = 'x'", "[hash_filter]\nmatch = 'some'", "[hash_filter]\nfields = ['x']", "[hash_filter]\nfields = []", "[hash_filter]\ninclude = 'x'", "a = ["):
        path.write_text(bad)
        with pytest.raises(C.SettingsError):
            C.load_settings(path)
    assert C.load_settings(tmp_path / "none") == C.Settings()
    with pytest.raises(C.SettingsError):
        C.load_settings(tmp_path / "none", required=True)
    assert C.setting(" c ", "E", "d", {"E": "e"}) == "c" and C.setting(None, "E", "d", {"E": "e"}) == "e" and C.setting("", "E", "d", {}) == "d"
    key = tmp_path / "key"
    key.write_text("k\n")
    assert (C.api_key("c", key, {"OPENAI_API_KEY": "e"}), C.api_key(" ", key, {"OPENAI_API_KEY": "e"}), C.api_key(None, key, {})) == ("c", "e", "k")
    key.write_text("")
    for path in (key, tmp_path / "gone"):
        with pytest.raises(C.SettingsError):
            C.api_key(None, path, {})


def test_options(tmp_path):
    s = C.Settings(linux_dir=tmp_path, hashes_file=tmp_path / "h", workers=3, hash_filter=C.Settings("hash_filter", source_file=tmp_path / "c", include=("a",)), cve_source=C.Settings("cve_source", inbox_dir=tmp_path))
    a = cli.filter_options([], s)
    assert (a.output_file, a.workers, a.include, a.max_diff_chars) == (tmp_path / "h", 3, ["a"], 0)
    assert cli.filter_options(["--include", "b", "--workers", "1"], s).include == ["b"]
    assert cli.extract_options([], s).output_file == tmp_path / "c"
    for bad in (["--workers", "0"], ["--max-diff-chars", "-1"]):
        with pytest.raises(C.SettingsError):
            cli.filter_options(bad, s)
    s = C.Settings(linux_dir=tmp_path, hashes_file=tmp_path / "h", context_md=tmp_path / "c")
    assert cli.analyze_options([], s).max_diff_chars == 50_000
    for bad in (["--start-index", "3", "--end-index", "2"], ["--end-index", "-2"], ["--max-tokens", "0"], ["--evidence-dir", str(tmp_path / "none")]):
        with pytest.raises(C.SettingsError):
            cli.analyze_options(bad, s)
