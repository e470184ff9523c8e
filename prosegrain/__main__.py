"""Command line: check files or folders, or run one detector. Exit 1 if something is an error, 2 if the settings are wrong or nothing is there to check.

coinage lists compounds that no dictionary has, of files or, with --diff, of the lines that a unified diff without context adds; it
needs a tokenizer, which the settings name (coinage.tokenizer = "module:function"). check looks for them if there is one.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrain.config import FILE_NAME, Config, discover, load
from prosegrain.operators import coinage, fixes, report
from prosegrain.plans.check import check
from prosegrain.sources import documents
from prosegrain.sources.folders import markdown_files

TEMPLATE = '# Settings of prosegrain.\nregister = "internal"\nallow = []\n\n[deny]\n# "phrase" = "what to write instead"\n'
DETECTORS = ("readability", "codemix", "calque")


def coined(lines: DataFrame, config: Config, tokenizer: Callable[[str], list[coinage.Morpheme]], args: argparse.Namespace) -> int:
    """Print the coinages of lines (file, line, text)."""
    allowed = lines.sparkSession.createDataFrame([(w,) for w in sorted({*config.allow, *config.coinage_allow})], "word string")
    found = coinage.coinages(coinage.tokenized(lines, tokenizer), allowed)
    n = 0
    for r in (found.where("strict") if args.strict else found).orderBy("file", "line", "seq").toLocalIterator():
        print(f"{r['file']}:{r['line']}: [coinage/dictionary-coinage] {r['compound']} ({' + '.join(r['components'])}) is in no dictionary")
        n += 1
    print(f"{n} compounds" + ("" if args.strict else ", functional ones included; --strict leaves those out"))
    return int(n > 0 and not args.advisory)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="prosegrain", description=__doc__)
    parser.add_argument("command", choices=("check", "fix", "init", "coinage", *DETECTORS))
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--format", choices=("text", "json", "github"), default="text")
    parser.add_argument("--register", choices=("internal", "practice", "consume", "external"))
    parser.add_argument("--advisory", action="store_true", help="exit 0 whatever is found")
    parser.add_argument("--out", help="folder for what fix writes; it must not exist")
    parser.add_argument("--allow", action="append", default=[], help="a registry or word list of what is allowed")
    parser.add_argument("--diff", action="store_true", help="coinage: only the lines that a unified diff on the standard input adds")
    parser.add_argument("--strict", action="store_true", help="coinage: only compounds that hold a plain noun of one character")
    args = parser.parse_args(argv)
    if args.command == "init":
        if Path(FILE_NAME).exists():
            print(f"{FILE_NAME} exists", file=sys.stderr)
            return 2
        Path(FILE_NAME).write_text(TEMPLATE)
        return 0
    try:
        config = load(discover(Path()), tuple(map(Path, args.allow)), register=args.register)
        tokenizer = coinage.named(config.coinage_tokenizer) if config.coinage_tokenizer else None
        if args.command == "coinage" and not tokenizer:
            raise ValueError("coinage needs coinage.tokenizer in the settings")
    except (ValueError, TypeError, OSError) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("prosegrain").getOrCreate()
    if tokenizer:
        coinage.sent(spark, config.coinage_tokenizer)
    if args.command == "coinage" and args.diff:
        diffs = spark.createDataFrame([(1, sys.stdin.read())], "id int, text string")
        return coined(documents.added_lines(diffs), config, tokenizer, args)
    if args.command in DETECTORS and not args.paths:
        docs = documents.from_text(spark, sys.stdin.read())
    else:
        for p in args.paths:
            if not Path(p).exists():
                print(f"{p} is not there", file=sys.stderr)
        files = [f for p in args.paths or ["."] for f in (markdown_files(p) if Path(p).is_dir() else [p] if Path(p).is_file() else [])]
        if not files:
            print("nothing to check", file=sys.stderr)
            return 2
        docs = documents.from_files(spark, list(dict.fromkeys(files)))
    if args.command == "coinage":
        lines = docs.select("file", F.posexplode(F.split("raw", "\n")).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")
        return coined(lines, config, tokenizer, args)
    if args.command == "fix":
        out = Path(args.out or "fixed").resolve()
        if out.exists():
            print(f"{out} exists", file=sys.stderr)
            return 2
        fixes.fixed(docs.where("kind <> 'html'").withColumnRenamed("raw", "text")).where("n > 0").write.json(str(out))
        return 0
    if args.command == "check" and not tokenizer:
        print("without coinage.tokenizer in the settings, coinages are not looked for", file=sys.stderr)
    found = check(docs, config, {args.command} if args.command in DETECTORS else None, tokenizer=tokenizer if args.command == "check" else None).cache()
    count = report.totals(found).first()
    if args.format == "json":
        print(report.json_report(found))
    else:
        for row in (report.text_lines(found) if args.format == "text" else report.annotations(found)).toLocalIterator():
            print(row["value"])
        if args.format == "text":
            print("OK" if not count["error"] + count["advisory"] else f"error {count['error']} / advisory {count['advisory']}")
    return int(bool(count["error"]) and not args.advisory and args.command != "codemix")


if __name__ == "__main__":
    sys.exit(main())
