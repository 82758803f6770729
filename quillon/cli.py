"""Commands of the corpus lifecycle: python -m quillon.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from . import cockpit, flows
from .operators import checks, release
from .sources import snapshot, statefile, web


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        own = commands.add_parser(name)
        for flag, options in arguments:
            own.add_argument(flag, **options)

    path = {"type": Path, "required": True}
    command("discover", ("--category", {"action": "append", "default": []}), ("--nominate", {"action": "append", "default": []}), ("--max-candidates", {"type": int, "default": 100}), ("--output", path))
    command("acquire", ("--discoveries", path), ("--data-dir", path), ("--dump-path", {"type": Path}), ("--retrieved-at", {}), ("--contact", {}), ("--download-rate-mib", {"type": int, "default": 16}))
    command("backup", ("--label", {"required": True}), ("--output-dir", path), ("--allow-dirty", {"action": "store_true"}))
    command("verify-backup", ("archive", {"type": Path}))
    command("curate", ("--articles-dir", path), ("--state-db", path), ("--review-deferred", {"action": "store_true"}))
    command("export-curation", ("--state-db", path), ("--output", path))
    command("load-curation", ("--input", path), ("--state-db", path))
    command("create-release", ("--release-id", {"required": True}), ("--articles-dir", path), ("--curation", path), ("--output", path))
    command("validate-release", ("manifest", {"type": Path}), ("--articles-dir", path), ("--curation", path))
    return parser


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _acquire(a: argparse.Namespace) -> str:
    if not 1 <= a.download_rate_mib <= 32:
        raise ValueError("a download takes 1 to 32 MiB a second")
    if a.dump_path and not a.retrieved_at:
        raise ValueError("--dump-path needs --retrieved-at")
    dump = a.dump_path or a.data_dir / "source" / checks.PINNED["filename"]
    if not dump.exists():
        web.download(checks.PINNED["source_url"], dump, a.contact or "", rate=a.download_rate_mib << 20)
    at = datetime.fromisoformat(a.retrieved_at) if a.retrieved_at else datetime.fromtimestamp(dump.stat().st_mtime, UTC)
    done = flows.acquire(_spark(), a.discoveries, dump, a.data_dir, at, lambda what: print(what, flush=True))
    return f"{len(done['successes'])} article(s), {len(done['failures'])} failure(s)"


def run(arguments: list[str], listing: web.Listing | None = None) -> str:
    """What a command has to say when it is done. listing: where categories are listed, for discover."""
    a = _parser().parse_args(arguments)
    if a.command == "discover":
        return f"{flows.discover(_spark(), a.output, a.category, a.nominate, a.max_candidates, listing, datetime.now(UTC))} candidate(s) in {a.output}"
    if a.command == "acquire":
        return _acquire(a)
    if a.command == "backup":
        return f"wrote {flows.create_backup(_spark(), Path.cwd(), a.label, a.output_dir, a.allow_dirty)}"
    if a.command == "verify-backup":
        return f"{release.verify_backup(a.archive)['label']} is sound"
    if a.command == "export-curation":
        statefile.export(a.state_db, a.output, flows.LABELS)
        return f"wrote {a.output}"
    if a.command == "load-curation":
        flows.load_curation(snapshot.file_lines(a.input), a.state_db)
        return f"made {a.state_db}"
    if a.command == "curate":
        if not (sys.stdin.isatty() and sys.stdout.isatty()):
            raise ValueError("curation needs a terminal")
        return cockpit.curate(_spark(), a.articles_dir, a.state_db, "deferred" if a.review_deferred else "undecided")
    if a.command == "create-release":
        document = flows.create_release(_spark(), a.release_id, a.articles_dir, a.curation, a.output)
    else:
        document = flows.validate_release(_spark(), a.manifest, a.articles_dir, a.curation)
    return f"{document['release_id']}: {document['counts']['articles']} article(s), {document['counts']['lore_passages']} passage(s)"


def main() -> int:
    try:
        print(run(sys.argv[1:]))
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
