"""Pieces of Java patterns that match as their RE2 counterparts do."""

from __future__ import annotations

#: An ASCII word boundary: Java's own \b knows all of Unicode.
B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def before(letters: str) -> str:
    """The boundary before a match that begins with one of these word characters; the letter is looked at first, as it rules out most places."""
    return f"(?=[{letters}])(?<![0-9A-Za-z_])"


#: White space without the vertical tab.
S = r"[\t\n\f\r ]"
#: What may follow a token: a quote, backtick, white space or semicolon, an escaped line end, or the end of the text.
END = r"(?:[\x60'\"\t\n\f\r ;]|\\[nr]|\z)"
W = r"[0-9A-Za-z_]"
#: Ignore case as RE2 does, beyond ASCII too.
CI = "(?iu)"
#: Unicode white space, as a class body.
UNICODE_SPACE = "\\t-\\r \\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def glob_regex(glob: str) -> str | None:
    """The body of a regular expression for a path glob, or None if the glob is malformed. `*`, `?` and classes never match a slash."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                return None
            body = glob[i + 1 : end].replace("[", "\\[").replace("&", "\\&")
            out.append(f"(?!/)[{body}]")
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out.append("\\" + glob[i] if not glob[i].isalnum() else glob[i])
        else:
            out.append("\\" + c if not (c.isalnum() or c in "_/") else c)
        i += 1
    return "".join(out)
