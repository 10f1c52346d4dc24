"""RE2 patterns for java.util.regex: rule packs are written in RE2 syntax and mean the same in Spark."""

from __future__ import annotations

_SPACE = r"\t\n\f\r "


def to_java(pattern: str) -> str:
    r"""The pattern with RE2's meaning of \s, $, . and \p{Han} spelt out; \b is refused, as it differs beyond ASCII."""
    out, i, in_class = ["(?d)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if pattern.startswith(r"\p{Han}", i):
                out.append(r"\p{IsHan}")
                i += 7
                continue
            if two == r"\s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif two == r"\S" and not in_class:
                out.append(f"[^{_SPACE}]")
            elif two in (r"\b", r"\B") and not in_class:
                raise ValueError("word boundaries differ between engines")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&~":
                c = "\\" + c
        elif c == "[":
            in_class = True
            lead = pattern[i + 1 : i + 3]
            if lead.startswith("^]") or lead.startswith("]"):
                out.append("[" + ("^" if lead[0] == "^" else "") + r"\]")
                i += 3 if lead[0] == "^" else 2
                continue
        elif c == "$":
            c = r"\z"
        out.append(c)
        i += 1
    return "".join(out)
