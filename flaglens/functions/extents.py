"""Where functions stand in source text, in bytes, without a native parser.

Python goes through the standard parser, and by indentation where that fails. Languages with braces are blanked first
(strings and comments become spaces of the same length), then headers are found and braces matched. In Go and among
constructors, plain functions count as well as methods. Macros are functions of C and C++ only.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from heapq import heappop, heappush

Extent = tuple[str, int, int]

_TOKENS = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|`[^`]*(?:`|\Z)|@"(?:[^"]|"")*(?:"|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)""")
_NOT_NAMES = frozenset("if for while switch catch return else do try new throw sizeof using lock foreach fixed synchronized when case func select go defer typeof nameof await in".split())
_HEADER = re.compile(r"(~?[A-Za-z_]\w*(?:::~?\w+)*)\s*(\()")
_GO_HEADER = re.compile(r"\bfunc\s*(?:\([^()]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(\()")
_AFTER = re.compile(r"\s*(?:const|override|final|noexcept|throws\s+[\w.,\s]+|where\s+[^{;]*|->\s*[\w:<>*&\s]+|:\s*[^{};]*|volatile|&&?)?\s*(?:override|final|noexcept)?\s*\{")
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)?(?:[^\n]*\\\n)*[^\n]*", re.M)


def _blank(source: str) -> str:
    return _TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _close(text: str, at: int, pair: str) -> int:
    """The place after the bracket that closes the one at `at`, or the end."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


def _bytes(source: str):
    if source.isascii():
        return lambda at: at
    starts, total = [], 0
    for line in source.split("\n"):
        starts.append(total)
        total += len(line) + 1
    sizes, done = [], 0
    for line in source.split("\n"):
        sizes.append(done)
        done += len(line.encode("utf-8", "surrogatepass")) + 1

    def place(at: int) -> int:
        i = bisect_right(starts, at) - 1
        return sizes[i] + len(source[starts[i] : at].encode("utf-8", "surrogatepass"))

    return place


def _python(source: str) -> list[Extent]:
    lines = source.split("\n")
    offsets, total = [], 0
    for line in lines:
        offsets.append(total)
        total += len(line.encode("utf-8", "surrogatepass")) + 1
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(lines, offsets)
    found = [(n.name, offsets[n.lineno - 1] + n.col_offset, offsets[n.end_lineno - 1] + n.end_col_offset) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    return sorted(found, key=lambda x: (x[1], -x[2]))


def _indented(lines: list[str], offsets: list[int]) -> list[Extent]:
    found = []
    for i, line in enumerate(lines):
        if m := re.match(r"(\s*)(?:async\s+)?def\s+(\w+)", line):
            end = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j
            found.append((m[2], offsets[i] + len(m[1]), offsets[end] + len(lines[end].encode("utf-8", "surrogatepass"))))
    return found


def extents(source: str, lang: str) -> list[Extent]:
    """(name, start, end exclusive) in order of start."""
    if lang == "python":
        return _python(source)
    if lang not in ("java", "csharp", "cpp", "c", "go"):
        return []
    text, place, found = _blank(source), _bytes(source), []
    for m in (_GO_HEADER if lang == "go" else _HEADER).finditer(text):
        if m[1] in _NOT_NAMES:
            continue
        shut = _close(text, m.start(2), "()")
        if lang == "go":
            brace = re.compile(r"[^\n{]*\{").match(text, shut)
        else:
            brace = _AFTER.match(text, shut)
            before = text[: m.start()].rstrip()
            if before.endswith((".", "=", ",", "(", "&", "|", "!", "?", "+", "new")) and not before.endswith(("&&", "*&")):
                continue
        if brace:
            line = text.rfind("\n", 0, m.start()) + 1
            low = max(line, text.rfind(";", line, m.start()) + 1, text.rfind("{", line, m.start()) + 1, text.rfind("}", line, m.start()) + 1)
            start = low + len(text[low : m.start()]) - len(text[low : m.start()].lstrip())
            found.append((m[1], place(start), place(_close(text, brace.end() - 1, "{}"))))
    if lang in ("cpp", "c"):
        for m in _MACRO.finditer(text):
            found.append((m[1] or f"macro@L{text.count(chr(10), 0, m.start()) + 1}", place(m.start()), place(m.end())))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def holders(names: list[str], starts: list[int], stops: list[int]) -> list[tuple[int, str | None]]:
    """(byte, name): from each byte up to the next one given, the first function that holds it, or None. Functions come in order;
    a name ranks by its first place and holds what its last one does, both ends included."""
    place: dict[str, tuple[int, int]] = {}
    for name, start, stop in zip(names, starts, stops, strict=True):
        place[name] = (start, stop)  # a name that comes again keeps its rank
    begun = sorted((start, rank, stop, name) for rank, (name, (start, stop)) in enumerate(place.items()) if start <= stop)
    found, holding, at = [], [], 0
    for byte in sorted({x for start, _, stop, _ in begun for x in (start, stop + 1)}):
        while at < len(begun) and begun[at][0] == byte:
            heappush(holding, begun[at][1:])
            at += 1
        while holding and holding[0][1] < byte:
            heappop(holding)
        found.append((byte, holding[0][2] if holding else None))
    return found
