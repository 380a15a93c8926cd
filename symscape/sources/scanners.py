"""Declarations of sources in other languages, by scanners written by hand (no grammar is needed): bracket structure first, then
declarations by what stands before and after a name. They see types, callables, constants, calls, heritage and raised errors; not
macros, nor types that must be inferred."""

from __future__ import annotations

import re
from bisect import bisect_right

from symscape.sources import web_code
from symscape.sources.make_code import make  # noqa: F401 (one of the scanners)
from symscape.sources.python_code import base, constant, signature, tight, unique

_BLANKED = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NOT_CALLS = set("if for while switch catch return sizeof typeof match when using lock fixed synchronized super function func fn fun def foreach elseif assert await yield throw throws in not and or unless until case".split())
_MODIFIERS = set("public private protected internal static final abstract sealed open override virtual async export default readonly const inline extern unsafe partial native synchronized suspend lateinit data case implicit lazy mut pub mutating fileprivate required convenience explicit constexpr noexcept friend template typename non-sealed final operator".split())
_ANY_MODIFIER = "|".join(map(re.escape, _MODIFIERS))

#: language -> (keywords of types by kind, keyword of callables or None where a type stands before the name)
TYPES = {
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "record"},
    "typescript": {"class": "class", "interface": "interface", "enum": "enum"},
    "csharp": {"class": "class", "struct": "class", "interface": "interface", "enum": "enum", "record": "record"},
    "kotlin": {"class": "class", "object": "class", "interface": "interface"},
    "scala": {"class": "class", "object": "class", "trait": "interface"},
    "swift": {"class": "class", "struct": "record", "enum": "enum", "protocol": "interface", "extension": "class", "actor": "class"},
    "php": {"class": "class", "interface": "interface", "trait": "class", "enum": "enum"},
    "rust": {"struct": "class", "enum": "enum", "trait": "interface", "impl": "", "mod": ""},
    "go": {"struct": "class", "interface": "interface"},
    "c": {"struct": "class", "enum": "enum", "union": "class"},
    "cpp": {"class": "class", "struct": "class", "enum": "enum", "namespace": "", "extern": ""},
}
#: Fields in the body of a type, n their name and t their type, once the bodies in it are gone.
_FIELDS = {
    "rust": r"(?:^|[,{\n])\s*(?:pub(?:\([^)]*\))?\s+)?(?P<n>[a-z_]\w*)\s*:(?!:)\s*(?P<t>(?:[^,<\n]|<[^>\n]*>)+)",
    "go": r"(?m)(?:^|;)\s*(?P<n>[A-Za-z_]\w*)\s+(?P<t>[\w.*\[\]]+)",
    "c": r"(?P<t>\w[\w\s]*?[\s*]+)(?P<n>\w+)(?:\[[^\]]*\])?\s*;",
    "swift": r"\b(?:let|var)\s+(?P<n>\w+)\s*:\s*(?P<t>[^;=\n{]+)",
}
KEYWORD = {"kotlin": "fun", "scala": "def", "swift": "func", "php": "function", "rust": "fn", "go": "func"}
TRANSPARENT = re.compile(r"\b(namespace|mod|extern|package|impl|companion\s+object)\b[^;{}]*$")


def blanked(text: str) -> str:
    """Comments as blanks and strings as quotes around blanks, of the same length."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text)


def pairs(code: str, opens: str, closes: str) -> dict[int, int]:
    out, stack = {}, []
    for m in re.finditer(f"[{re.escape(opens + closes)}]", code):
        if m[0] in opens:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | dict.fromkeys(stack, len(code))


def split_top(raw: str) -> list[str]:
    """Parts between commas outside all brackets; a blank last one is dropped."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(raw):
        depth += (c in "<([{") - (c in ">)]}" and raw[i - 1 : i] not in ("-", "="))
        if c == "," and depth == 0:
            parts.append(raw[start:i])
            start = i + 1
    return parts + [raw[start:]] * bool(raw[start:].strip())


def parameter(raw: str, lang: str) -> tuple[str, str]:
    """(type, name)."""
    p = re.sub(r"[@#]\[?\w+(\([^)]*\))?\]?\s*", "", raw).split("=")[0].strip()
    if lang in ("typescript", "kotlin", "scala", "swift", "rust"):
        name, _, kind = p.partition(":")
        return tight(kind.strip()) or "?", re.sub(r"\b(?:private|public|protected|readonly|val|var|mut|ref)\s+", "", name).strip().split(" ")[-1].rstrip("?").lstrip("&.")
    words = [w for w in p.replace("*", "* ").split() if w not in ("final", "const", "in", "out", "ref", "params", "this", "mut")]
    if lang == "go":
        return (tight(" ".join(words[1:])), words[0]) if len(words) > 1 else ("?", words[0] if words else "")
    if lang == "php":
        name = next((w for w in words if "$" in w), "")
        return tight(" ".join(w for w in words if w != name and w not in ("private", "public", "protected", "readonly"))) or "?", name.lstrip("&.$")
    return (tight(" ".join(words[:-1])), words[-1].lstrip("&*")) if len(words) > 1 else (tight(" ".join(words)) or "?", "")


def heritage(head: str) -> tuple[list[str], list[str]]:
    """(supers, permits) from what stands between a type's name and its body."""
    names = lambda part: [re.split(r"[.\\:]", base(n.strip().split(" ")[-1]))[-1] for n in split_top(part) if n.strip()]
    found: dict[str, list[str]] = {}
    words = re.split(r"\b(extends|implements|permits|with|where)\b", head)
    for k, part in zip(words[1::2], words[2::2], strict=True):
        found[k] = found.get(k, []) + names(part)
    supers = [n for k in ("extends", "implements", "with") for n in found.get(k, [])]
    colon = re.match(r"\s*(?:<[^{]*?>)?\s*(?:\([^{]*\))?\s*:(?!:)\s*(.*)$", words[0], re.S)
    return supers or (names(re.sub(r"\b(public|private|protected|virtual)\b", "", re.sub(r"\([^)]*\)", "", colon[1]))) if colon else []), found.get("permits", [])


def calls_in(code: str, own: str) -> list[str]:
    out = []
    for m in re.finditer(r"(?<![\w$.])((?:[\w$]+(?:\.|::|->|\?\.))*)([A-Za-z_$][\w$]*)\s*(?:<[\w, .]+>)?\(", code):
        chain = re.sub(r"::|->|\?\.", ".", m[1]).replace("$", "").rstrip(".").split(".")
        if m[2] not in _NOT_CALLS and m[2] != own:
            out.append(f"{chain[-1]}.{m[2]}" if chain[-1] else m[2])
    return unique(out)


def raises_in(code: str, clause: str) -> list[str]:
    stated = [x.strip().split(".")[-1] for x in clause.split(",") if x.strip()]
    return unique(stated + re.findall(r"\bthrow\s+(?:new\s+)?(?:[\w]+\.)*([A-Z]\w*)", code))


def bindings_of(params: list[tuple[str, str]], code: str) -> dict[str, str]:
    out = {n: base(t) for t, n in params if n and t != "?"}
    for m in re.finditer(r"\b(?:(?:var|val|let|const|auto)\s+(\w+)\s*(?::\s*([A-Z]\w*)[^=;\n]*)?=\s*(?:new\s+)?([A-Z]\w*)?|([A-Z]\w*)(?:<[^>;]*>)?\s+(\w+)\s*[=;])", code):
        name, kind = (m[1], m[2] or m[3]) if m[1] else (m[5], m[4])
        if kind:
            out[name] = kind
    return out


def decorators_before(text: str, at: int) -> tuple[list[str], int]:
    """Annotations that stand right before a place, and where they begin."""
    head = text[:at]
    found: list[str] = []
    while m := re.search(r"(?:@([\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?)|#?\[([^\[\]]+)\])\s*\Z", head):
        found.insert(0, m[1] or m[2])
        head = head[: m.start()]
    return [d if '"' in d or "'" in d else tight(d) for d in found], len(head)


def braces(text: str, lang: str) -> list[dict]:
    code = blanked(text)
    lines = [m.start() for m in re.finditer("\n", code)]
    line = lambda i: bisect_right(lines, i - 1) + 1
    curly, round_ = pairs(code, "{", "}"), pairs(code, "(", ")")
    keywords = TYPES[lang]
    open_to_all: set[str] = set()  # types whose members are public unless they say otherwise
    types: list[tuple[int, int, str]] = []  # body of each type with its name; "" is looked through
    out: list[dict] = []

    def visible(before: str, name: str, member: bool) -> str:
        words = set(before.split())
        if lang == "go":
            return ("priv", "pub")[name[:1].isupper()]
        if lang == "rust":
            return "pub" if "pub" in before else "priv"
        if lang == "c":
            return "priv" if "static" in words else "pub"
        if lang == "typescript" and not member:
            return "pub" if "export" in words else "priv"
        if lang in ("csharp",):
            return "pub" if "public" in words or "interface" in words else "priv"
        return "priv" if words & {"private", "protected", "fileprivate"} or name.startswith("#") else "pub"

    pattern = r"\btype\s+(?P<name>\w+)\s+(?P<key>struct|interface)\b" if lang == "go" else rf"\b(?P<key>{'|'.join(keywords)})\s+(?P<name>[\w.]+)" if lang not in ("rust", "cpp") else rf"\b(?P<key>{'|'.join(keywords)})\b(?:\s*<[^>]*>)?\s+(?:(?:\w|::)+(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)"
    for m in re.finditer(pattern, code):
        stop = re.compile(r"[{;]").search(code, m.end())
        name, body = m["name"].split(".")[-1], stop.start() if stop and stop[0] == "{" else None
        if m["key"] == "case" or body is None and lang in ("c", "cpp", "go") or lang in ("c", "cpp") and re.search(r"[()=*&]", code[m.end() : body]):
            continue
        if name in ("class", "struct"):  # enum class E
            name = re.match(r"\s*(\w*)", code[m.end() :])[1]
        end = curly.get(body, len(code)) if body is not None else m.end()
        kind = keywords[m["key"]]
        start = max(code.rfind(c, 0, m.start()) for c in ";{}") + 1
        notes, _ = decorators_before(re.sub(r"(?:\b(?:%s)\b\s*)+$" % _ANY_MODIFIER, "", text[start : m.start()]), len(text))
        if not kind:
            if m["key"] == "impl":
                types.append((body, end, name))
                trait = re.match(r"impl(?:\s*<[^>]*>)?\s+((?:\w|::)+)(?:<[^>]*>)?\s+for\s", code[m.start() : m.end() + 1])
                for row in out:
                    if trait and row["name"] == name and "supers" in row:
                        row["supers"] = unique(row["supers"] + [trait[1].split("::")[-1]])
            else:
                types.append((body, end, ""))
            continue
        head = code[m.end() : body if body is not None else stop.start() if stop else len(code)]
        supers, permits = heritage(head)
        row = {"name": name, "line": line(m.start("name")), "signature": f"{m['key']} {name}", "visibility": visible(code[start : m.start()], name, False), "supers": supers, "permits": permits, "decorators": notes}
        inside = code[body + 1 : end] if body is not None else ""
        if kind == "class" and ("data" in code[start : m.start()].split() or "case" in code[start : m.start()].split()):
            kind = "record"
        first = re.match(r"\s*(?:<[^>]*>)?\s*\(", head)
        if first and (kind == "record" or lang == "kotlin"):
            at = m.end() + first.end() - 1
            parts = [parameter(p, lang) for p in split_top(code[at + 1 : round_.get(at, at + 1)])]
            row |= {"params": [t for t, _ in parts], "fields": [n for _, n in parts]}
        if kind == "enum":
            row["params"] = [x for x in (re.match(r"\s*(?:case\s+)?([A-Za-z_]\w*)", p) and re.match(r"\s*(?:case\s+)?([A-Za-z_]\w*)", p)[1] for p in split_top(inside.split(";")[0])) if x]
        if kind in ("class", "record") and not row.get("fields") and lang in _FIELDS:
            flat = re.sub(r"\{[^{}]*\}", "", inside)
            parts = [(m2["n"], tight(m2["t"].strip())) for m2 in re.finditer(_FIELDS[lang], flat)]
            row |= {"fields": [n for n, _ in parts], "params": [t for _, t in parts]}
        if kind == "interface":
            open_to_all.add(name)
        if body is not None:
            types.append((body, end, name))
        out.append(row | {"kind": kind, "_at": m.start()})

    def shown(at: int, before: str, name: str, container: str | None) -> str:
        if lang == "cpp" and container:
            body = next((b for b, e, n in types if n == container and b < at < e), None)
            if body is None:
                return "pub"
            labels = re.findall(r"\b(public|private|protected)\s*:(?!:)", code[body:at])
            struct = re.search(r"\bstruct\b[^;{}]*$", code[:body])
            return "pub" if (labels[-1] == "public" if labels else struct) else "priv"
        if container in open_to_all and "private" not in before.split():
            return "pub"
        return visible(before, name, bool(container))

    def owner(at: int) -> str | None:
        """The type right around a place, "" at the top, None within anything else."""
        around = [(a, b) for a, b in curly.items() if a < at < b]
        if not around:
            return ""
        a = max(around)[0]
        by = {body: name for body, _, name in types}
        if a in by:
            return by[a] or owner(a)
        return owner(a) if TRANSPARENT.search(code[max(0, a - 120) : a]) else None

    for m in re.finditer(r"([~A-Za-z_$#][\w$]*)\s*(?:<[\w ,.:&]+>|\[[\w ,]+\])?\s*\(", code):
        name, at = m[1], m.end() - 1
        close = round_.get(at)
        if close is None or name in _NOT_CALLS or name in _MODIFIERS:
            continue
        inside = owner(m.start())
        if inside is None:
            continue
        start = max(code.rfind(c, 0, m.start()) for c in ";{}") + 1
        before = code[start : m.start()]
        qualifier = None
        if lang == "cpp":
            before = re.sub(r"\b(?:public|private|protected)\s*:(?!:)", "", re.sub(r"\btemplate\s*<[^>]*>", "", before))
            q = re.search(r"(?:(\w+)(?:<[^<>]*>)?::)+~?$", before)
            if q:
                qualifier, before = q[1], before[: q.start()]
        if re.search(r"\[\s*$", before) or before.split()[-1:] and before.split()[-1] in keywords:
            continue  # an attribute, or the head of a type
        after = re.match(r"\s*(?:throws\s+(?P<throws>[\w.,\s]+?)(?=\s*[{;])|(?:->|:|=>)?\s*(?P<ret>[\w.<>\[\],?&*:| ()]*?)|const|noexcept|override|\s)*\s*(?P<end>=>|[{;=]|$)", code[close + 1 : close + 400])
        word = KEYWORD.get(lang)
        receiver = None
        if word:
            if inside and (lang, name) in (("swift", "init"), ("kotlin", "constructor")):
                word = ""
            k = re.search(r"$", before) if not word else re.search(rf"\b{word}\b\s*(?:\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*)?$", before) if lang == "go" else re.search(rf"\b{word}\b\s*(?:<[^>]*>\s*)?(?:\w+\.)?&?\s*$", before)
            if not k:
                continue
            receiver, before = (k[1] if lang == "go" else None), before[: k.start()]
        elif lang == "typescript":
            if not inside and code.count("(", 0, m.start()) > code.count(")", 0, m.start()):
                continue  # an argument, not a declaration
            if not (re.search(r"\bfunction\b\s*\*?\s*$", before) or inside and after and after["end"] in ("{", ";")):
                continue
            if inside and not re.fullmatch(r"[\s\w@(),.'\"<>]*", before):
                continue
        else:
            words = re.sub(r"@\w+(\([^)]*\))?", "", before).split()
            constructor = inside and name == inside and not [w for w in words if w not in _MODIFIERS]
            if not constructor and (not [w for w in words if w not in _MODIFIERS] or words[-1] in ("return", "new", "else", "throw", "=", "case") or re.search(r"[=.(]\s*$", before)):
                continue
            if lang in ("c", "cpp") and not (after and after["end"] in ("{", ";")):
                continue
        ends = after["end"] if after else ""
        body = close + 1 + after.start("end") if ends == "{" else None
        stop = curly.get(body, len(code)) if body is not None else None
        inner = code[body + 1 : stop] if body is not None else ""
        if ends == "=" and lang in ("kotlin", "scala"):  # a body that is one expression
            at_end = code.find("\n", close)
            inner = code[close + 1 + after.end("end") : at_end if at_end >= 0 else len(code)]
        parts = [parameter(p, lang) for p in split_top(code[at + 1 : close])]
        parts = [p for p in parts if p[1] not in ("self", "&self") and p[0] != "void"]
        stated = re.match(r"\s*(?:(?:async|throws|rethrows|const)\b\s*)*(?:->|:(?!:))\s*(?P<ret>[^{};=\n]+?)\s*(?=[{};=\n]|\bwhere\b|$)", code[close + 1 : body if body is not None else close + 400])
        returns = tight(stated["ret"]) if stated else None
        if lang in ("java", "csharp", "c", "cpp"):
            kept = [w for w in re.sub(r"@\w+(\([^)]*\))?|\[[^\]]*\]", "", before).split() if w not in _MODIFIERS]
            returns = tight(" ".join(kept)) or None
        elif lang == "go":
            returns = code[close + 1 : body].strip() or None if body is not None else returns
        notes, _ = decorators_before(re.sub(r"(?:(?<![@\w])(?:%s)\b\s*|(?<![@\w])[\w<>,.?]+(?:\[\])*\s+)*$" % _ANY_MODIFIER, "", text[start : m.start()]), len(text)) if lang not in ("go", "c") else ([], 0)
        container = receiver or qualifier or inside or None
        made = name in ("constructor", "__construct", "init") or container and name.lstrip("~") == container
        out.append({
            "name": name, "kind": "ctor" if made and container else "method" if container else "fn", "line": line(m.start()), "params": [t for t, _ in parts], "param_names": [n for _, n in parts], "returns": None if made else returns,
            "signature": signature(name, [t for t, _ in parts], None if made else returns), "visibility": shown(m.start(), before, name, container), "container": container,
            "calls": calls_in(inner, name), "raises": raises_in(inner, (after and after["throws"]) or ""), "bindings": bindings_of(parts, inner), "decorators": notes,
            "size": line(stop) - line(body) + 1 if body is not None else 0, "_at": m.start(),
        })
    if lang == "typescript":
        square = pairs(code, "[", "]")
        given = lambda raw: [parameter(p, lang) for p in split_top(raw)]
        within = lambda inner, name, parts: {"calls": calls_in(inner, name), "raises": raises_in(inner, ""), "bindings": bindings_of(parts, inner)}
        out += web_code.top_level(text, code, line, round_, curly, square, given, within)
        for m in re.finditer(r"(?m)^(?:export\s+)type\s+(\w+)[^=\n]*=\s*([^;\n]+)", code):
            out.append({"name": m[1], "kind": "type", "line": line(m.start(1)), "signature": f"type {m[1]}={tight(m[2].strip())[:40]}", "_at": m.start()})
        for m in re.finditer(r"(?m)^export\s*\{([^}]*)\}\s*from", code):
            out += [{"name": n.strip().split(" ")[-1], "kind": "reexport", "line": line(m.start()), "signature": n.strip(), "_at": m.start()} for n in m[1].split(",") if n.strip()]
    constants = {"java": r"static\s+final\s+[\w<>\[\], ]+\s+([A-Z][A-Z0-9_]*)\s*=\s*([^;\n]+);", "typescript": r"(?m)^(?:export\s+)?const\s+([A-Z][A-Z0-9_]*)\s*(?::[^=\n]+)?=\s*([^;\n]+)", "csharp": r"\b(?:const|static\s+readonly)\s+[\w<>]+\s+(\w+)\s*=\s*([^;\n]+);", "kotlin": r"\bconst\s+val\s+(\w+)[^=\n]*=\s*([^\n;]+)", "go": r"(?m)^const\s+(\w+)[^=\n]*=\s*([^\n]+)", "rust": r"\b(?:const|static)\s+([A-Z][A-Z0-9_]*)\s*:[^=;]+=\s*([^;\n]+);", "php": r"\bconst\s+(\w+)\s*=\s*([^;\n]+);", "swift": r"\bstatic\s+let\s+(\w+)[^=\n]*=\s*([^\n;]+)", "scala": r"\bval\s+([A-Z][A-Z0-9_]*)[^=\n]*=\s*([^\n;]+)"}.get(lang)
    for m in re.finditer(constants, code) if constants else ():
        value = text[m.start(2) : m.end(2)].strip()
        if lang == "typescript" and (not re.match(r"-?[\d.]|[\"'`\[{]|(?:true|false)\b", value) or m[1] in {r["name"] for r in out}):
            continue  # what a call makes is no constant
        scalar = re.fullmatch(r"-?[\d._]+\w?|\"[^\"]*\"|'[^']*'|true|false|null|nil", value)
        out.append({"name": m[1], "kind": "const", "line": line(m.start(1)), "signature": constant(m[1], value if scalar else None), "container": owner(m.start()) or None, "_at": m.start()})
    return [{k: v for k, v in r.items() if k != "_at"} for r in sorted(out, key=lambda r: r["_at"])]


def ruby(text: str) -> list[dict]:
    out, stack, private = [], [], False
    for n, raw in enumerate(text.splitlines(), 1):
        s = raw.strip()
        if m := re.match(r"(?:class|module)\s+([\w:]+)(?:\s*<\s*([\w:]+))?", s):
            stack.append((m[1].split("::")[-1], len(raw) - len(raw.lstrip())))
            private = False
            out.append({"name": stack[-1][0], "kind": "class", "line": n, "signature": f"class {stack[-1][0]}", "supers": [m[2].split("::")[-1]] if m[2] else []})
        elif s in ("private", "protected"):
            private = True
        elif s == "public":
            private = False
        elif m := re.match(r"attr_\w+\s+(.*)", s):
            next((r for r in reversed(out) if r["kind"] == "class"), {"fields": []}).setdefault("fields", []).extend(re.findall(r":(\w+)", m[1]))
        elif m := re.match(r"def\s+(?:self\.)?([\w?!=]+)\s*(?:\(([^)]*)\))?", s):
            names = [p.strip().split("=")[0].strip() for p in (m[2] or "").split(",") if p.strip()]
            owner = stack[-1][0] if stack else None
            kind = "ctor" if m[1] == "initialize" else "method" if owner else "fn"
            out.append({"name": m[1], "kind": kind, "line": n, "params": ["?"] * len(names), "param_names": names, "signature": f"{m[1]}({','.join('?' * len(names))})", "container": owner, "visibility": "priv" if private else "pub", "calls": [], "_indent": len(raw) - len(raw.lstrip())})
        elif s == "end":
            indent = len(raw) - len(raw.lstrip())
            if stack and stack[-1][1] == indent:
                stack.pop()
                private = False
            for r in out:
                if r.get("_indent") == indent:
                    r["size"] = n - r["line"] + 1
                    r.pop("_indent")
        else:
            for r in reversed(out):
                if "_indent" in r:
                    r["calls"] = unique(r["calls"] + calls_in(re.sub(r"#.*", "", s), r["name"]))
                    break
    return [{k: v for k, v in r.items() if k != "_indent"} for r in out]


def lua(text: str) -> list[dict]:
    out = []
    for m in re.finditer(r"(?m)^[ \t]*(local\s+)?function\s+(?:(\w+)[.:])?(\w+)\s*\(([^)]*)\)(.*?)(?=^[ \t]*(?:local\s+)?function\s|\Z)", re.sub(r"--[^\n]*", "", text), re.S):
        names = [p.strip() for p in m[4].split(",") if p.strip()]
        out.append({"name": m[3], "kind": "method" if m[2] else "fn", "line": text[: m.start(3)].count("\n") + 1, "container": m[2], "params": ["?"] * len(names), "param_names": names, "signature": f"{m[3]}({','.join('?' * len(names))})", "visibility": "priv" if m[1] or m[3].startswith("_") else "pub", "calls": calls_in(m[5].replace(":", "."), m[3])})
    return out


def bash(text: str) -> list[dict]:
    out = []
    for n, s in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{?|\s*function\s+([A-Za-z_][\w-]*)\s*\{", s):
            out.append({"name": m[1] or m[2], "kind": "method", "line": n, "signature": f"{m[1] or m[2]}()", "calls": []})
        elif m := re.match(r"(?:readonly\s+|export\s+|declare\s+-r\s+)*([A-Z][A-Z0-9_]*)=(\S*)\s*$", s):
            out.append({"name": m[1], "kind": "const", "line": n, "signature": constant(m[1], None if re.search(r"[$`]", m[2]) else m[2])})
    known = {r["name"] for r in out if r["kind"] == "method"}
    current = None
    for n, s in enumerate(text.splitlines(), 1):
        current = next((r for r in out if r["kind"] == "method" and r["line"] == n), current)
        if current and current["line"] != n:
            current["calls"] = unique(current["calls"] + [w for w in re.findall(r"(?:^|[;&|(]|\$\()\s*([A-Za-z_][\w-]*)", s) if w in known and w != current["name"]])
    return out


def css(text: str) -> list[dict]:
    code = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    seen: dict[str, dict] = {}
    for m in re.finditer(r"@keyframes\s+([\w-]+)|(--[\w-]+)\s*:|([.#][A-Za-z_][\w-]*)(?=[^;{}]*\{)", code):
        name = m[1] or m[2] or m[3]
        seen.setdefault(name, {"name": name, "kind": "fn", "line": code[: m.start()].count("\n") + 1, "signature": name, "visibility": "priv"})
    return list(seen.values())


def html(text: str) -> list[dict]:
    seen: dict[str, dict] = {}
    for m in re.finditer(r"<([a-z][a-z0-9]*-[\w-]*)|\bid\s*=\s*[\"']([^\"']+)[\"']", text):
        name = m[1] or "#" + m[2]
        seen.setdefault(name, {"name": name, "kind": "fn", "line": text[: m.start()].count("\n") + 1, "signature": name, "visibility": "priv", "calls": [name] if m[1] else []})
    return list(seen.values())


def helm(text: str, path: str) -> list[dict]:
    """Charts, values and templates in a chart's layout; other files of these suffixes have no rows."""
    rows, file = [], path.split("/")[-1]
    add = lambda name, kind, at, **more: rows.append({"name": name, "kind": kind, "line": text[:at].count("\n") + 1, "signature": name} | more)
    if file in ("Chart.yaml", "Chart.yml"):
        for m in re.finditer(r"(?m)^name:\s*[\"']?([\w.-]+)", text):
            add(m[1], "class", m.start())
    elif re.fullmatch(r"values[\w.-]*\.ya?ml", file):
        for m in re.finditer(r"(?m)^([A-Za-z_][\w-]*):", text):
            add(m[1], "const", m.start())
    elif "templates" in path.split("/")[:-1] or file.endswith(".tpl"):
        for m in re.finditer(r"\{\{-?\s*define\s+\"([^\"]+)\"", text):
            end = text.find("{{- define", m.end())
            add(m[1], "fn", m.start(), calls=unique(re.findall(r"\b(?:include|template)\s+\"([^\"]+)\"", text[m.end() : end if end > 0 else len(text)])))
    return rows


def single_file(text: str, lang: str, path: str) -> list[dict]:
    """A component row, and what its scripts declare."""
    name = re.sub(r"\.[^.]+$", "", path.split("/")[-1])
    rows = [{"name": name, "kind": "class", "line": 1, "signature": f"component {name}", "calls": unique(re.findall(r"<([A-Z]\w*)", text)), "lang": lang}]
    for m in re.finditer(r"<script[^>]*>(.*?)</script>", text, re.S):
        rows += [r | {"line": r["line"] + text[: m.start(1)].count("\n"), "lang": "typescript"} for r in braces(m[1], "typescript")]
    return rows
