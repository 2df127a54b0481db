"""A thin command line over ``Repository``: ``python -m siltstone COMMAND ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from siltstone.functions.digest import HASHES, NATIVE
from siltstone.plans.repository import Repository, RepositoryError
from siltstone.sources.store import StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone", description="Versioned, deduplicated working directories.")
    top.add_argument("-C", dest="folder", default=".", help="the working directory, or one below it")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **more: dict) -> None:
        p = commands.add_parser(name)
        for a in arguments:
            p.add_argument(a.rstrip("*?"), **({"nargs": a[-1]} if a[-1] in "*?" else {}))
        for option, how in more.items():
            p.add_argument("--" + option, **how)

    command("init", "store?", hash={"choices": sorted(HASHES), "default": NATIVE})
    command("clone", "url", "target")
    command("status")
    command("stage", "paths*")
    command("unstage", "paths*")
    command("commit", message={}, author={}, amend={"action": "store_true"}, force={"action": "store_true"})
    command("log", "ref?")
    command("show", "path?", ref={"default": "HEAD"})
    command("checkout", "ref?", "paths*")
    command("branch", "name?", mode={"choices": ["error", "overwrite", "nothing"], "default": "error"}, delete={"action": "store_true"}, upstream={})
    command("remote", "name?", "url?")
    for name in ("fetch", "push", "pull"):
        command(name, "name?")
    command("fsck", "ref?", hash={"choices": sorted(HASHES)})
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines that a command prints."""
    folder, c = os.path.abspath(args.folder), args.command
    if c == "init":
        return [f"made {Repository.init(spark, folder, args.store, args.hash).base}"]
    if c == "clone":
        return [f"cloned to {Repository.clone(spark, args.url, os.path.abspath(args.target)).base}"]
    repo = Repository.search(spark, folder)
    if c == "status":
        s = repo.status()
        rows = sorted((r["change"], "/".join(r["path"])) for r in s["staged"].toLocalIterator())
        return [f"head {s['head'] or 'none'}, candidate {s['candidate'] or 'none'}", *(f"{change} {path}" for change, path in rows)]
    if c in ("stage", "unstage"):
        getattr(repo, c)(*(os.path.join(folder, p) for p in args.paths or ["."]))
        return []
    if c == "commit":
        return [repo.commit(args.message, args.author, amend=args.amend, force=args.force).hex()]
    if c == "log":
        return [f"{bytes(r['digest']).hex()} {r['seconds']} {r['name'] or ''} {r['message'] or ''}" for r in repo.log(args.ref or "HEAD").toLocalIterator()]
    if c == "show":
        return [f"{r['kind']} {bytes(r['digest']).hex()} {r['size'] or ''} {r['name']}" for r in repo.show(args.path or "", args.ref).orderBy("name").toLocalIterator()]
    if c == "checkout":
        return [f"wrote {repo.checkout(args.ref or 'HEAD', args.paths or None)} files"]
    if c == "branch":
        if args.name is None:
            return [f"{r['kind']} {r['remote'] + '/' if r['remote'] else ''}{r['branch']} {bytes(r['digest']).hex()}" for r in repo.branches().orderBy("kind", "remote", "branch").toLocalIterator()]
        if args.delete:
            repo.branch_delete(args.name)
        elif args.upstream is not None:
            remote, _, branch = args.upstream.partition("/")
            repo.set_upstream(args.name, remote or None, branch or None)
        else:
            repo.branch_create(args.name, mode=args.mode)
        return []
    if c == "remote":
        if args.name is None:
            return [f"{r['remote']} {r['url']}" for r in repo.remotes().collect()]
        repo.remote_add(args.name, args.url)
        return []
    if c == "fsck":
        return [f"wrong {bytes(r['stored']).hex()}" for r in repo.fsck(args.ref or "HEAD", args.hash).toLocalIterator()]
    getattr(repo, c)(*([args.name] if args.name else []))
    return []


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    try:
        print("\n".join(run(spark, args)))
        return 0
    except (RepositoryError, StoreError, ValueError) as e:
        print(f"siltstone: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
