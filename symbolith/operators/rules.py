"""Extraction rules as data: the first rule of a language that matches a line gives its symbol."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    category: str
    pattern: str  # Java; group 1 is the name
    refuse: tuple[str, ...] = ()  # names that are no symbols: the rule then doesn't match


# File extensions and their languages.
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".go": "go",
    ".rs": "rust", ".html": "html", ".sh": "bash", ".bash": "bash", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".md": "markdown", ".java": "java",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".scala": "scala",
}

# Control words that look like calls in C-like languages.
CONTROL = (
    "if", "for", "while", "switch", "catch", "return", "sizeof", "do", "else", "synchronized", "throw", "throws", "new", "super", "this", "using", "lock", "foreach",
    "await", "yield", "when", "match", "guard", "defer", "repeat",
)

# Notation. Java's \w and \b are used as they are: ASCII letters, digits and the underscore. A repeated group is possessive
# (``++``), so Java runs it as a loop, not as a recursion, and no line is tried in more ways than its length.
W = r"\w"
NAME = r"[A-Za-z_]\w*"
JS_NAME = r"[A-Za-z_$][\w$]*"


def either(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def declared(keywords: str, name: str = NAME, before: str = "", after: str = "", between: str = "", start: str = r"^\s*+") -> str:
    """A line that declares ``name``: annotations and modifiers, one key word or several, what stands between, the name."""
    own = set(keywords.split())
    words = " ".join(w for w in before.split() if w not in own)  # a key word ends the modifiers
    lead = rf"(?:@\w[\w.]*+(?:\([^)]*+\))?+\s++|{either(words)}(?:\([a-z ]++\))?+\s++)*+" if words else ""
    several = "++" if start.startswith("^") else ""  # a start that isn't anchored would try each of many key words
    return rf"{start}{lead}(?:{either(keywords)}\s++){several}{between}({name}){after}"


# Modifiers of each language's grammar.
_CLASS_MODIFIERS = "public private protected internal static final abstract sealed partial unsafe readonly strictfp implicit lazy case open data inner annotation value expect actual file new ref non-sealed"
_METHOD_MODIFIERS = _CLASS_MODIFIERS + " override virtual async extern native synchronized default transient volatile def fun suspend inline operator infix tailrec"
_SWIFT = "public private fileprivate internal open static class final override mutating nonmutating required convenience indirect dynamic lazy weak"
_PHP = "public private protected static final abstract readonly"
_RUST = "pub async unsafe const extern default"
# a type with its arguments: white space stands only behind a comma
_TYPE = r"(?:[\w<>\[\]?.&*]++(?:\s*+,\s*+)?+)++"


def _created(what: str, after: str = "") -> str:
    """A statement that creates something of a kind, replaced or temporary or not, quoted or not."""
    options = r"(?:OR\s++REPLACE\s++|TEMP(?:ORARY)?\s++)*+"
    return rf"(?i)\bCREATE\s++{options}{either(what)}\s++(?:IF\s++NOT\s++EXISTS\s++)?+[\"'`]?+({W}++)[\"'`]?+{after}"


# Definitions by language, in the order in which they are tried.
_OOP = (
    Rule("classes", declared("class interface enum record struct trait object", before=_CLASS_MODIFIERS)),
    Rule("variables", declared("namespace", r"[A-Za-z_][\w.]*")),
    Rule("functions", rf"^\s*+(?:@\w++\s++)*+(?:{either(_METHOD_MODIFIERS)}\s++(?!\())++(?:<[^>]*+>\s*+)?+(?:{_TYPE}\s++(?!\())?({NAME})\s*+\(", CONTROL),
)
_C = (
    Rule("classes", declared("struct class enum union", before="typedef static extern template")),
    # a type, the name, parameters without an end of statement, and a body that opens on the line
    Rule("functions", rf"^(?![\s#])(?:[\w:<>,]++[\s*&]++(?!\())++(?:\w++::)*+({NAME})\s*+\([^;{{]*\)\s*+(?:(?:const|noexcept|override)\s*+)*+\{{\s*+\}}?+\s*+\z", CONTROL),
)
_GO_RECEIVER = rf"(?:\(\s*(?:{W}+\s+)?\*?{W}+(?:\[[^\]]*\])?\s*\)\s*)?"
RULES: dict[str, tuple[Rule, ...]] = {
    "java": _OOP,
    "csharp": _OOP,
    "scala": _OOP,
    "kotlin": (
        # type parameters, and the type that an extension extends
        Rule("functions", declared("fun", NAME, _METHOD_MODIFIERS, r"\s*\(", between=r"(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?")),
        Rule("classes", declared("class interface object enum", before=_CLASS_MODIFIERS)),
    ),
    "swift": (Rule("functions", declared("func", before=_SWIFT, after=r"\s*[(<]")), Rule("classes", declared("class struct enum protocol actor", before=_SWIFT))),
    "ruby": (Rule("functions", declared("def", r"[a-z_]\w*[?!=]?", between=r"(?:self\.)?")), Rule("classes", declared("class module", r"[A-Z]\w*"))),
    "php": (Rule("functions", declared("function", before=_PHP, after=r"\s*\(", between=r"&?\s*")), Rule("classes", declared("class interface trait enum", before=_PHP))),
    "c": _C,
    "cpp": _C,
    "python": (
        Rule("functions", rf"^(?:async\s+)?def\s+({W}+)\s*[(\[]"),
        Rule("classes", rf"^class\s+({W}+)\s*[(:\[]"),
        Rule("functions", rf"^\s+(?:async\s+)?def\s+([A-Za-z0-9]{W}*)\s*[(\[]"),  # methods, but none that start with an underscore
        Rule("variables", r"^([A-Z0-9_]+)\s*(?::[^=]+)?=(?!=)"),  # constants by convention
    ),
    "go": (
        Rule("functions", rf"^func\s+{_GO_RECEIVER}({W}+)\s*[(\[]"),
        Rule("classes", rf"^type\s+({W}+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
        Rule("variables", rf"^(?:const|var)\s+({W}+)\b(?!\s*\()"),
    ),
    "rust": (
        Rule("functions", declared("fn", rf"{W}+", _RUST, start="^")),
        Rule("classes", rf"^(?:pub(?:\([a-z: ]+\))?\s+)?(?:struct|enum|trait|union)\s+({W}+)"),
        Rule("variables", rf"^(?:pub(?:\([a-z: ]+\))?\s+)?(?:const|static(?:\s+mut)?)\s+({W}+)\s*:"),
    ),
    # a function of a shell has the key word, or parentheses behind its name, or both
    "bash": (
        Rule("functions", declared("function", rf"{W}+", after=rf"(?!{W})")),
        Rule("functions", rf"^\s*+({W}++)\s*+\(\s*+\)", ("if", "while", "for", "case", "until")),
    ),
    "sql": (Rule("classes", _created("TABLE VIEW", r"\s*+\(")), Rule("functions", _created("FUNCTION PROCEDURE"))),
    "yaml": (Rule("variables", r"^([A-Za-z_][\w-]*+)\s*+:"),),
}
# Languages whose definitions may be nested, as a parser would see them; which are outer, their braces tell.
NESTED = {
    "go": (RULES["go"][0], Rule("classes", rf"^type\s+({W}+)\s"), RULES["go"][2]),
    "rust": (Rule("functions", declared("fn", rf"{W}+", _RUST)), *RULES["rust"][1:]),
}
# Scripts that don't parse, by line: what a statement may start behind, then a declaration.
_STATEMENT = r"(?:^|[\s;{}(),=!:])"
_PARAMETERS = rf"(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)|{JS_NAME})"
JS_FALLBACK = (
    Rule("functions", rf"{_STATEMENT}function\s*+(?:\*\s*+)?+({JS_NAME})\s*+\("),
    Rule("functions", declared("const let var", JS_NAME, after=rf"\s*+=\s*+(?:async\b\s*+)?+{_PARAMETERS}\s*+=>", start=_STATEMENT)),
    Rule("classes", declared("class", r"[A-Z][\w$]*", start=_STATEMENT)),
)

# Routes, mounts and module exports of JavaScript lines.
ROUTE = r"(?:router|app)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
MOUNT = r"app\.use\s*\(\s*['\"`](/api[^'\"`]*)['\"`]"
MEMBER_EXPORT = rf"^(?:module\.)?exports\.({W}+)\s*="
BULK_EXPORT = r"^module\.exports\s*=\s*\{([^}]+)\}"

# Declarations that a skeleton of any other language shows.
SKELETON = (
    r"^\s*(?:export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+|pub\s+)*(?:def|func|fn|fun|function)\s+\w+",
    r"^\s*(?:export\s+|public\s+|private\s+|abstract\s+|final\s+|sealed\s+|data\s+|pub\s+)*(?:class|struct|interface|trait|enum|protocol|module|record|object|type|impl)\s+\w+",
    r"^\s*(?:(?:public|private|protected|internal|static|final|override|virtual|abstract|async)\s+)+[\w<>\[\],?.\s]+\([^;]*\)\s*\{?\s*$",
    r"^(?:const|var|let|static)\s+\w+",
)
