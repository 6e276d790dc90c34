"""Option files of the command line: ``name = value`` lines."""

from __future__ import annotations


class OptionFileError(ValueError):
    """What is wrong with an option file, with its line."""


def read_options(path: str, allowed: set[str]) -> dict[str, str]:
    """Options of a file; # starts a comment line, _ is - in names, and leading dashes don't count."""
    found: dict[str, str] = {}
    with open(path, encoding="utf-8") as lines:
        for number, line in enumerate(lines, 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            name, given, value = line.partition("=")
            name, value = name.strip().removeprefix("--").replace("_", "-"), value.strip()
            problem = "no value" if not given or not value else f"unknown option {name!r}" if name not in allowed else f"{name!r} is set twice" if name in found else ""
            if problem:
                raise OptionFileError(f"{path}, line {number}: {problem}")
            found[name] = value
    return found
