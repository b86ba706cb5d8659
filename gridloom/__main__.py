"""Command line: python -m gridloom VERB ..."""

from __future__ import annotations

import argparse
import sys

from gridloom import __version__


def _tile(s: str) -> tuple[int, ...]:
    return tuple(map(int, s.split(",")))


def _floats(s: str) -> tuple[float, ...]:
    return tuple(map(float, s.split(",")))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("-v", "--verbose", dest="log", action="store_true", help="show what Spark logs")
    p.add_argument("--cpuprofile", help="write a profile of the driver to this file")
    p.add_argument("--version", action="version", version=f"gridloom {__version__}")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, inputs: str, out: bool = False, **flags):
        v = sub.add_parser(name)
        v.add_argument("inputs", nargs=inputs)
        if out:
            v.add_argument("-o", "--output", required=name != "crop")
            v.add_argument("-f", "--force", action="store_true")
        for flag, options in flags.items():
            v.add_argument(f"--{flag.replace('_', '-')}", **options)

    yes = {"action": "store_true"}
    verb("merge", "+", True, tile={"type": _tile})
    verb("diff", "+", ignore_comment=yes, ignore_timestamp=yes, strict=yes, verbose=yes)
    verb("delta", "+", True, semantic=yes)
    verb("apply", "+", True, semantic=yes)
    verb("crop", "+", True, bbox={"type": _floats}, center={"type": _floats}, distance={"type": float}, estimate_size=yes)
    verb("dump", "+", all=yes, header=yes, tile={"type": _tile})
    verb("load", "+", True)
    verb("validate", "+")
    verb("tags", "+")
    verb("hash", "+", ignore_comment=yes, ignore_timestamp=yes)
    verb("edit", "+", True, comment={}, timestamp={"type": int})
    return p


def main(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if not a.cpuprofile:
        return run(a)
    import cProfile

    with cProfile.Profile() as profile:
        code = run(a)
    profile.dump_stats(a.cpuprofile)
    return code


def run(a: argparse.Namespace) -> int:
    from gridloom import verbs
    from gridloom.session import local_session

    spark, i = local_session(), a.inputs
    if a.log:
        spark.sparkContext.setLogLevel("INFO")
    if a.verb == "merge":
        verbs.merge(spark, i, a.output, a.tile, a.force)
    elif a.verb == "diff":
        found = verbs.diff(spark, i[0], i[1], a.ignore_comment, a.ignore_timestamp, a.strict)
        differs = False
        for name, df in found.items():
            if name == "elements" and not a.verbose:
                continue
            for r in df.toLocalIterator():
                differs = True
                print(name, *r)
        return int(differs)
    elif a.verb in ("delta", "apply"):
        if a.verb == "delta":
            verbs.delta(spark, i[0], i[1], a.output, a.force)
        else:
            verbs.apply(spark, i[0], i[1:], a.output, a.force)
        if a.semantic:
            print(f"SEMANTIC_HASH: {verbs.file_digest(spark, i[1] if a.verb == 'delta' else a.output)}")
    elif a.verb == "crop":
        if a.estimate_size:
            print(verbs.estimate_size(spark, i[0], a.bbox, a.center, a.distance)["bytes"])
        else:
            verbs.crop(spark, i[0], a.output, a.bbox, a.center, a.distance, a.force)
    elif a.verb == "dump":
        for line in verbs.dump(spark, i[0], a.header, a.all, a.tile):
            print(line)
    elif a.verb == "load":
        verbs.load(spark, i[0], a.output, a.force)
    elif a.verb == "validate":
        rows = 0
        for r in verbs.validate(spark, ",".join(i)).toLocalIterator():
            rows += 1
            print(*r)
        return int(rows > 0)
    elif a.verb == "tags":
        for line in verbs.tag_report(spark, i):
            print(line)
    elif a.verb == "hash":
        print(verbs.file_digest(spark, i[0], a.ignore_comment, a.ignore_timestamp))
    elif a.verb == "edit":
        verbs.edit(spark, i[0], a.output, a.comment, a.timestamp, a.force)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
