"""Languages: names, file extensions, and the fixed patterns and word lists that tell toggles and their use."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Results depend on these patterns and words as they stand.
LINE_COMMENTS = {
    "python": r"^\s*#.*$",
    "csharp": r"^\s*//.*$",
    "java": r"^\s*//.*$",
    "go": r"^\s*//.*$",
    "cpp": r"^\s*//.*$",
    "config": r"^\s*[#!;].*$",
}
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
CAPITALS = r"(?P<toggle>[A-Z][A-Z0-9_-]{2,})"
DECLARATIONS = {
    "python": {
        "declare": r"(?P<toggle>\w+)\s*(?:\:\s*(?P<type>[^\s=]+))?\s*=\s*",
        "capital_identifiers": CAPITALS,
        "dict_keys": r"[{,]\s*(?P<toggle>(?:['\"][^'\"]*['\"]|[^:]+?))\s*:",
        "enum_names": r"class\s+(?P<toggle>\w+)\(Enum\):",
    },
    "csharp": {
        "declare": r"(public|protected|private\s+protected|private)\s+(?:static\s+|const\s+|readonly\s+)*(\w+(?:\s*<[^>]+>)?)\s+(?P<toggle>\w+)\s*(?=\s*(=|;|\[))",
        "capital_identifiers": CAPITALS,
        "dict_keys": r"[{,]\s*(?P<toggle>(?:@\"[^\"]*\"|\"[^\"]*\"|'[^']*'|[^,\s]+?))\s*,",
        "enum_names": r"enum\s+(?P<toggle>\w+)\s*",
    },
    "java": {
        "declare": r"(public|protected|private)\s+(?:static\s+|final\s+|volatile\s+|transient\s+)*(?P<type>\w+(?:\s*<[^>]+>)?)\s+(?P<toggle>\w+)\s*(?=\s*(=|;|\[))",
        "getter_method": r"\b\w+\.\w+\((?P<toggle>.*?)\)",
        "method_call": r"(?P<toggle>[a-zA-Z0-9_]+)\s*=\s*\w+\.\w+\((.*?)\)",
        "field_access": r"\b[A-Za-z0-9_]+::(?P<toggle>\w+)\b",
        "interface_declaration": r"boolean\s+(?P<toggle>[a-zA-Z0-9_]+)\(\);",
        "capital_identifiers": CAPITALS,
        "dict_keys": r"\bput\s*\(\s*(?P<toggle>\"[^\"]*\"|'[^']*'|[^,\s]+?)\s*,",
        "enum_names": r"enum\s+(?P<toggle>\w+)\s*",
    },
    "go": {
        "declare": r"(?:var\s+(?P<toggle>\w+)\s*(?:\s+(?P<type>[^\s=]+))?\s*(?:=\s*.*)?|(?P<toggle2>\w+)\s*(?:\s+(?P<type2>[^\s=]+))?\s*:=\s*.*)",
        "toggle_usage": r"\b(?P<toggle>\w+)\b(?=\s*[=:\(\{\},])",
        "toggle_in_condition": r"(?P<toggle>\w+)\b(?=.*?\()",
        "struct_declaration": r"\b(?:bool|int|string|float64)\s+(?P<toggle>\w+)",
        "declare2": r"\s+(?P<toggle>\w+)\s* =",
        "capital_identifiers": CAPITALS,
        "dict_keys": r"[{,]\s*(?P<toggle>(?:`[^`]*`|\"[^\"]*\"|'[^']*'|[\w.]+?))\s*:",
        "enum_names": r"type\s+(?P<toggle>\w+)\s+int\s*",
    },
    "cpp": {
        "declare": r"(?:(?:const|static|volatile|extern|mutable)\s+)*(?P<type>(?:[\w:]+)(?:\s*<[^>;]+>)?(?:\s*::\s*[\w:]+)*(?:\s*[\*&])?)\s+(?P<toggle>\w+)\s*(?=\s*(=|;|\[))",
        "capital_identifiers": CAPITALS,
        "dict_keys": r"[{,]\s*(?P<toggle>(?:\"[^\"]*\"|'[^']*'|[^,\s]+?))\s*,",
        "toggle_names": r"(Feature)?(Toggle|Flag|Enable|Disable)?\w*::(?P<toggle>\w+),",
        "enum_names": r"enum\s+(?P<toggle>\w+)\s*",
    },
    "config": {
        "toggle_definition": r"^\s*(?P<toggle>[a-zA-Z0-9._-]+)\s*=\s*.*$",
        "toggle_colon_definition": r"^\s*(?P<toggle>[a-zA-Z0-9._-]+)\s*:\s*.*$",
        "capital_identifiers": r"(?P<toggle>[A-Z][A-Z0-9._-]{2,})",
    },
}
LEVEL_WORDS = ('"CRITICAL"', '"ERROR"', '"WARNING"', '"INFO"')
KEYWORDS = {
    "python": ("__", "__main__", "True", "False", "None", "async", "await", "self", '"true"', '"false"', "__name__", *LEVEL_WORDS),
    "csharp": ("public", "private", "protected", "const", "static", "readonly", "string", "Dictionary", "List", "bool", '"true"', '"false"', *LEVEL_WORDS),
    "java": ("public", "private", "protected", "static", "final", "volatile", "transient", "String", "Map", "List", "boolean", '"true"', '"false"', *LEVEL_WORDS),
    "go": ("var", "const", "func", "int", "string", "bool", "map", '"true"', '"false"', "err", "ok", *LEVEL_WORDS),
    "cpp": ("const", "static", "public", "private", "protected", "bool", "int", "float", "double", "std", '"true"', '"false"', *LEVEL_WORDS),
    "config": ("true", "false", "null", "none", "undefined", "enabled", "disabled"),
}
#: A line is a condition if any of these is found in it. (Patterns that need a line break can't match a line and are left out.)
BRACE_CONDITIONS = (
    r"if\s*\(.*?\)\s*\{",
    r"\?.*?:",
    r"\b&&|\|\|\b",
    r"\b\w+\((.*?)(&&|\|\|)(.*?)\)",
    r"\w+\s*=\s*.*?;",
    r"return\s+.*?;",
    r"(if|return)\s*\(.*?\)",
)
CONDITIONS = {
    "python": (
        r"return\s+(.*?)\s+and",
        r"if\s+(.*?)\s+and",
        r"return\s+(.*?)\s+or",
        r"if\s+(.*?)\s+or",
        r"(\b(and|or)\b.*\\n)+",
        r"\b\w+\((.*?)(and|or)(.*?)\)",
        r"[^=]=\s+(.*?) and",
        r"[^=]=\s+(.*?) or",
        r"if\s.*:\s*if\s.*:",
        r"return\s+.*(?:and|or).*",
        r"\belif\s+.*:",
        r"(if|elif|return|and|or)\s+(.*?)\b",
        r"\b(and|&&)\b",
        r"\b(or|\|\|)\b",
    ),
    "java": BRACE_CONDITIONS,
    "csharp": BRACE_CONDITIONS,
    "cpp": BRACE_CONDITIONS,
    "c": BRACE_CONDITIONS,
    "go": (
        r"if\s*.*?\s*\{",
        r"\b&&|\|\|\b",
        r"\b\w+\((.*?)(&&|\|\|)(.*?)\)",
        r"\w+\s*=\s*.*?;",
        r"return\s+.*?;",
        r"(if|return)\s*.*?\{",
    ),
}
ENUMS = {
    "java": r"enum\s+(\w+)\s*\{([^}]*)\}",
    "python": r"class\s+(\w+)\(Enum\):\s*([^#]*)",
    "go": r"const\s*\((.*?)\)",
    "cpp": r"enum\s+(\w+)?\s*\{([^}]*)\}",
    "csharp": r"enum\s+(\w+)\s*\{([^}]*)\}",
    "c": r"enum\s+(\w+)?\s*\{([^}]*)\}",
}
BUILD_FLAG = r"#if\s+BUILDFLAG\s*\(\s*(\w+)\s*\)"
BUILD_FLAG_LANGUAGES = ("cpp", "c", "csharp")
#: %s stands for the toggle, as a literal.
PARENTS = {
    "cpp": (r"(class .+)\s*\n?\{", r"(namespace .+)\s*\n?\{"),
    "csharp": (r"(namespace .*);",),
    "go": (r"\npackage (.*)(\n)",),
    "java": (r"class (.*( extends|implements \w*)*) \{[\s\S]*%s",),
    "python": (r"class (.*?)\:\n((?!.*class).*?\n)*?.*?%s",),
    "config": (r"(?i)(toggle|feature|flag)\s*[:=]\s*\w+", r"(?i)(parent_toggle|base_toggle)\s*[:=]\s*\w+"),
}
INVALID_CHARS = r"[(){}\[\]|\;<> !@]|https?://|localhost:"
PURE_NUMBER = r'^"?\d+([-_\.]\d+)*"?$'
MIN_LENGTH = 11
#: A value like one of these speaks against a toggle, unless it looks like a call.
WRONG_VALUES = (
    r"[\{\[\(]",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b\d+%+",
    r"(https?://[^\s]+)",
    r'([a-zA-Z]:\\|\/)[^<>:"|?*]+(?:\\|\/)[^<>:"|?*]*',
    r"\b[a-z]{2}\b",
    r"None|Null|none|null|undefined",
)
CALL_VALUE = r"\w+\s*\(.*"
PROXIMITY = 3
# End of the fixed values.

ALIASES = {"c++": "cpp", "cc": "cpp", "c#": "csharp", "cs": "csharp", "golang": "go", "py": "python"}
CODE_EXTENSIONS = {"cpp": ("cc", "cpp", "mm", "m"), "go": ("go",), "java": ("java",), "python": ("py",), "csharp": ("cs",), "c": ("c", "h")}
#: For telling a language by a config file's extension, in this order of languages.
CONFIG_EXTENSIONS = {"python": ("py",), "java": ("java",), "cpp": ("cpp", "cc", "cxx", "hpp"), "go": ("go",), "javascript": ("js",), "typescript": ("ts",), "csharp": ("cs",)}
ASK_EXTENSIONS = ("properties", "conf", "cfg", "tsx")
CONTENT_PROBES = (("java", ("import java",)), ("cpp", ("#include <",)), ("python", ("def ",)), ("go", ("package main",)), ("javascript", ("function ", "console.log")), ("csharp", ("namespace ", "using System")))
BLOCK_COMMENT_LANGUAGES = ("java", "csharp", "cpp", "go", "c")
PATTERNS = ("dead", "spread", "nested", "mixed", "enum")


def canonical(language: str | None) -> str:
    """The one id of a language, whatever its spelling."""
    if not language:
        raise ValueError("a language is needed")
    name = language.strip().lower()
    return ALIASES.get(name, name)


@dataclass(frozen=True)
class Pattern:
    """A pattern in Python's notation and the number of the group that is the toggle."""

    name: str
    text: str
    group: int

    @property
    def java(self) -> str:
        return "(?Ud)" + self.text.replace("(?P<", "(?<")


@dataclass
class Language:
    name: str
    declarations: tuple[Pattern, ...] = ()
    keywords: tuple[str, ...] = ()
    line_comment: str | None = None
    block_comments: bool = False
    conditions: tuple[str, ...] = ()
    enum: str | None = None
    build_flag: str | None = None
    parents: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()

    @property
    def condition(self) -> str:
        """One pattern for all conditions, in Java's notation."""
        return "(?Ud)" + "|".join(f"(?:{c})" for c in self.conditions)


_languages: dict[str, Language] = {}


def register_language(language: Language) -> None:
    """Add a language, or replace one."""
    _languages[language.name] = language


def language(name: str) -> Language:
    found = _languages.get(canonical(name))
    if not found:
        raise ValueError(f"unsupported language: {name}")
    return found


def languages() -> list[str]:
    return sorted(_languages)


def _pattern(name: str, text: str) -> Pattern:
    return Pattern(name, text, re.compile(text).groupindex["toggle"])


for _name in ("python", "java", "cpp", "c", "go", "csharp", "config"):
    register_language(
        Language(
            _name,
            tuple(_pattern(k, v) for k, v in DECLARATIONS.get(_name, {}).items()),
            KEYWORDS.get(_name, ()),
            LINE_COMMENTS.get(_name),
            _name in BLOCK_COMMENT_LANGUAGES,
            CONDITIONS.get(_name, ()),
            ENUMS.get(_name),
            BUILD_FLAG if _name in BUILD_FLAG_LANGUAGES else None,
            PARENTS.get(_name, ()),
            CODE_EXTENSIONS.get(_name, ()),
        )
    )
