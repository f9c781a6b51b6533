"""Command line over one document: python -m kobza normalize|uncertain|sentences|tokens [--preset P] [--file F | --stdin | TEXT ...]

uncertain prints a line for each span; --fail-on SEVERITY makes the exit code 2 where a span reaches it. Errors of use give 1.
"""

from __future__ import annotations

import argparse
import sys

from kobza.operators import segment
from kobza.operators.diagnostics import scanner
from kobza.operators.normalize import build
from kobza.operators.spans import SEVERITIES
from kobza.options import chosen_options
from kobza.sources.lexicons import Lexicons
from kobza.sources.text import load_vocabulary


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(1, f"{message}\n")


def main(arguments: list[str]) -> int:
    parser = Parser(prog="kobza")
    parser.add_argument("job", choices=["normalize", "uncertain", "sentences", "tokens"])
    parser.add_argument("--preset")
    parser.add_argument("--vocabulary")
    parser.add_argument("--fail-on", type=lambda s: {"warn": "Warning"}.get(s.lower(), s.capitalize()), choices=SEVERITIES)
    source = parser.add_mutually_exclusive_group()
    source.add_argument("--file")
    source.add_argument("--stdin", action="store_true")
    parser.add_argument("text", nargs="*")
    a = parser.parse_intermixed_args(arguments)
    if bool(a.text) + bool(a.file) + a.stdin != 1:
        parser.error("one of a text, --file and --stdin is expected")
    if a.file:
        with open(a.file, encoding="utf-8") as file:
            text = file.read()
    else:
        text = sys.stdin.read() if a.stdin else " ".join(a.text)
    tables = Lexicons()
    if a.job == "normalize":
        print(build(chosen_options(preset=a.preset, vocabulary=load_vocabulary(a.vocabulary) if a.vocabulary else None), tables)(text))
        return 0
    if a.job != "uncertain":
        for _, _, part in (segment.tokens if a.job == "tokens" else segment.sentences)(text):
            print(part)
        return 0
    found = scanner(None, tables)(text)
    for start, stop, part, reason, category, severity in found:
        print(start, stop, severity, category, part, reason, sep="\t")
    reached = a.fail_on and any(SEVERITIES.index(s[5]) >= SEVERITIES.index(a.fail_on) for s in found)
    return 2 if reached else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
