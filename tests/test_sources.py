import subprocess

import pytest
from pyspark.sql import functions as F

from marlstone.sources import files as sources
from marlstone.sources import git
from marlstone.streaming import event_activity


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-C", str(at), "-c", "user.name=Ann", "-c", "user.email=ann@x", *args], check=True, capture_output=True)

    run("init", "-b", "main")
    (at / "a.py").write_text("def f():\n    return 1\n")
    (at / ".mailmap").write_text("Ann B <b@x> <ann@x>\nZed <z@x> Old Zed <old@x>\n")
    (at / "sub").mkdir()
    (at / "sub" / "b.txt").write_text("b\n")
    run("add", "-A")
    run("commit", "-m", "First\n\nbody")
    (at / "a.py").write_text("def f():\n    return 2\n")
    run("commit", "-am", "Fix bug")
    run("checkout", "-b", "side", "HEAD~1")
    (at / "c.txt").write_text("c\n")
    run("add", "-A")
    run("commit", "-m", "Side")
    run("checkout", "main")
    run("merge", "--no-ff", "-m", "Merge", "side")
    (at / "blob.bin").write_bytes(b"a\0b")
    return str(at)


def test_git_sources(spark, repository):
    commits = git.read_git(spark, "git_log", repository)
    assert {r["subject"]: r["is_merge"] for r in commits.collect()} == {"First": False, "Fix bug": False, "Side": False, "Merge": True}
    paths = git.read_git(spark, "git_paths", repository).join(commits.select("id", "subject"), "id")
    assert {(r["subject"], r["path"]) for r in paths.collect()} == {("First", ".mailmap"), ("First", "a.py"), ("First", "sub/b.txt"), ("Fix bug", "a.py"), ("Side", "c.txt")}
    tree = {r["path"]: r["size"] for r in git.read_git(spark, "git_tree", repository).collect()}
    assert tree == {".mailmap": 46, "a.py": 22, "c.txt": 2, "sub/b.txt": 2}
    assert git.read_git(spark, "git_index", repository).count() == 4
    assert git.discover(repository) and git.scope_of(repository, repository + "/sub") == "sub"
    with pytest.raises(ValueError):
        git.scope_of(repository, "/")


def test_mailmap_and_worktree(spark, repository):
    got = {tuple(r) for r in git.mailmap(git.blob_lines(spark, repository, ".mailmap")).collect()}
    assert got == {("Ann B", "b@x", None, "ann@x"), ("Zed", "z@x", "Old Zed", "old@x")}
    assert git.blob_lines(spark, repository, "none").count() == 0
    lines = spark.createDataFrame([("path = a/b",), (" path=../x",), ("url = y",)], "value string")
    assert [r["path"] for r in git.submodules(lines).collect()] == ["a/b"]


def test_worktree(spark, repository):
    import os

    os.makedirs(f"{repository}/inner/.git", exist_ok=True)
    os.makedirs(f"{repository}/.github", exist_ok=True)
    for path, text in {"inner/x.py": "x = 1\n", ".github/run.py": "y = 2\n", ".gitignore": "skipped.py\n", "skipped.py": "z = 3\n", "_own.py": "w = 4\n", "large.py": "#" * 5000}.items():
        with open(f"{repository}/{path}", "w") as f:
            f.write(text)
    if not os.path.islink(f"{repository}/link.py"):
        os.symlink("a.py", f"{repository}/link.py")
    found, left, nested = sources.read_worktree(spark, repository, max_bytes=4000, exclude=["*.txt"])
    own = {r["path"]: r["language"] for r in found.collect()}
    assert own == {"a.py": "python", ".github/run.py": "python", "_own.py": "python"}
    assert {r["path"]: r["reason"] for r in left.collect()} == {
        ".gitignore": "non_source", ".mailmap": "non_source", "blob.bin": "non_source", "c.txt": "explicit_exclusion", "sub/b.txt": "explicit_exclusion", "skipped.py": "ignored_untracked", "large.py": "oversized", "link.py": "symlink",
    }
    assert [r["path"] for r in nested.collect()] == ["inner"]
    with pytest.raises(ValueError):
        os.symlink(repository, f"{repository}/loop") if not os.path.islink(f"{repository}/loop") else None
        git.scope_of(repository, f"{repository}/loop")


def test_resolved_changes(spark, repository):
    found, unsure = git.resolve_changes(spark, repository, revisions="HEAD~1..HEAD")
    assert [tuple(r) for r in found.collect()] == [("added", "c.txt", None)] and unsure.count() == 0
    with open(f"{repository}/a.py", "a") as f:
        f.write("# more\n")
    found, _ = git.resolve_changes(spark, repository, dirty=True)
    got = {(r["kind"], r["path"]) for r in found.collect()}
    assert ("modified", "a.py") in got and ("untracked", "blob.bin") in got and not any(p == "c.txt" for _, p in got)
    back, lost = git.resolve_changes(spark, repository, base="HEAD", head="HEAD~1")
    assert [tuple(r) for r in lost.collect()] == [("deleted_source", "c.txt")] and back.count() == 1
    with pytest.raises(ValueError):
        git.revision_ends(revisions="a...b")
    assert git.commit_summary(repository, most=2) == {"total": 4, "returned": 2, "truncated": True}


def test_streamed_activity_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = event_activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("activity").exceptAll(event_activity(events)).count() == 0
    assert event_activity(events).agg(F.sum("events")).first()[0] == events.count()
