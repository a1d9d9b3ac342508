"""Names that other programs take: variables of R, and files."""

from __future__ import annotations

import re

# The words that R reserves.
RESERVED = ("if", "else", "repeat", "while", "function", "for", "in", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "NA_integer_", "NA_real_", "NA_complex_", "NA_character_", "...")


def check_variable(name: str, what: str = "the name") -> None:
    """An error where a name is no variable name of R."""
    if not name:
        raise ValueError(f"{what} is empty")
    if re.match(r"\.\d", name):
        raise ValueError(f"{what} {name!r} begins with a period and a digit")
    if not (name[0] == "." or name[0].isidentifier()):
        raise ValueError(f"{what} {name!r} has to begin with a letter, a period or an underscore")
    if wrong := sorted(set(re.findall(r"[^\w.]", name))):
        raise ValueError(f"{what} {name!r} may not hold {' '.join(wrong)}")
    if name in RESERVED or re.fullmatch(r"\.\.\d+", name):
        raise ValueError(f"{what} {name!r} is reserved")


def quoted(name: str) -> str:
    """The name as R takes it in a formula: in backticks where it is no variable name."""
    try:
        check_variable(name)
    except ValueError:
        return "`" + name.replace("\\", "\\\\").replace("`", "\\`") + "`"
    return name


def file_name(name: str) -> str:
    """The name as part of a path: slashes become hyphens."""
    return name.replace("/", "-")
