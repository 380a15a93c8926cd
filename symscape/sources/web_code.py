"""What modules of web frameworks declare at their top beside functions and classes: routes, wrapped components, objects of functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from symscape.sources.python_code import signature, tight

WRAPPERS = ("memo", "React.memo", "forwardRef", "React.forwardRef", "observer")
_DECLARED = re.compile(r"(?m)^(?P<export>export\s+(?:default\s+)?)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*")
_WRAPPED = re.compile(rf"({'|'.join(map(re.escape, WRAPPERS))})\s*(?:<[^>()]*>)?\s*\(\s*")
_FUNCTION = re.compile(r"\s*(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*(?:<[^>()]*>)?\s*\(|(?:<[^>()]*>)?\s*\(|[\w$]+\s*=>)")


def _function(code: str, at: int, round_: dict[int, int], curly: dict[int, int]) -> tuple[str, str | None, int, int] | None:
    """(arguments, return type, begin and end of the body) of the function or arrow function that stands at a place."""
    m = _FUNCTION.match(code, at)
    if not m:
        return None
    if m[0].rstrip().endswith("=>"):
        args, after = m[0].replace("async", "").replace("=>", "").strip(), m.end() - 2
        rest = re.compile(r"=>").match(code, after)
        returns = None
    else:
        close = round_.get(m.end() - 1)
        if close is None:
            return None
        args = code[m.end() : close]
        rest = re.compile(r"\s*(?::\s*(?P<ret>[^={;]+?))?\s*(?:=>|(?=\{))").match(code, close + 1)
        returns = rest and rest["ret"]
    if not rest:
        return None
    begin = rest.end() + len(code[rest.end() :]) - len(code[rest.end() :].lstrip())
    if code[begin : begin + 1] == "{":
        return args, returns, begin, curly.get(begin, len(code))
    end = min(x for x in (code.find("\n", begin), code.find(";", begin), len(code)) if x >= 0)
    return args, returns, begin, end


def routes(text: str, code: str, begin: int, end: int, curly: dict[int, int]) -> list[str]:
    """/path→Component of the objects of a list, /path where one has no component; nested lists belong to their own objects."""
    out = []
    at = begin + 1
    while (at := code.find("{", at, end)) >= 0:
        close = curly.get(at, end)
        own = re.sub(r"[\[{].*", "", code[at + 1 : close], flags=re.S)
        path = re.search(r"\bpath\s*:\s*(['\"])", own)
        if path:
            start = at + 1 + path.end()
            name = text[start : code.find(path[1], start)]
            component = re.search(r"\bcomponent\s*:\s*([\w$.]+)", own)
            out.append(f"/{name}→{component[1]}" if component else f"/{name}")
        at = close + 1
    return out


def top_level(text: str, code: str, line: Callable[[int], int], round_: dict[int, int], curly: dict[int, int], square: dict[int, int], parts: Callable[[str], list[tuple[str, str]]], body: Callable[[str, str, list], dict]) -> list[dict]:
    """Rows for `const name = …` at the top of a module: functions, functions in a wrapper, lists of routes, objects of functions.

    parts: (type, name) of arguments; body: calls, raises and bindings of a body (its code, the function's name, its arguments)."""
    out: list[dict] = []

    def function(name: str, at: int, found, exported: bool, container: str | None, props: str | None = None, wrapper: str | None = None) -> None:
        args, returns, begin, end = found
        given = parts(args)
        params = [t for t, _ in given]
        if props and all(p == "?" for p in params):
            params = [props]
        out.append({
            "name": name, "kind": "method" if container else "fn", "line": line(at), "params": params, "param_names": [n for _, n in given], "returns": returns, "signature": signature(name, params, returns), "visibility": "pub" if exported else "priv",
            "container": container, "decorators": [wrapper] if wrapper else [], "size": line(end) - line(begin) + 1, "_at": at,
        } | body(code[begin:end], name, given))

    for m in _DECLARED.finditer(code):
        annotated = re.compile(r":\s*(?P<type>[^=\n]+(?:=>[^=\n]+)*?)\s*(?==[^=>])").match(code, m.end())
        equals = re.compile(r"\s*=\s*").match(code, annotated.end() if annotated else m.end())
        if not equals:
            continue
        props = re.search(r"(?:React\.)?(?:FC|FunctionComponent)<(.+)>$", tight(annotated["type"].strip())) if annotated else None
        at, exported, name = equals.end(), bool(m["export"]), m["name"]
        wrap = _WRAPPED.match(code, at)
        if code[at : at + 1] == "[":
            end = square.get(at, len(code))
            listed = routes(text, code, at, end, curly)
            if listed:
                out.append({"name": name, "kind": "const", "line": line(m.start("name")), "signature": f"{name}={','.join(listed)}", "visibility": "pub" if exported else "priv", "_at": m.start()})
        elif code[at : at + 1] == "{":
            end = curly.get(at, len(code))
            members = []
            k = at + 1
            while k < end:
                key = re.compile(r"[\s,]*(?:async\s+)?(?:get\s+|set\s+)?\*?(['\"]?)(?P<key>[\w$]+)\1\s*(?P<how>[(:])").match(code, k)
                if not key:
                    break
                start = key.end("how")
                found = _function(code, key.start("how") if key["how"] == "(" else start, round_, curly)
                if found:
                    members.append((key["key"], key.start("key"), found))
                    k = found[3] + 1
                else:
                    k = start
                    while k < end and code[k] != ",":
                        k = next((d[k] for d in (curly, round_, square) if k in d), k) + 1
            if members:
                out.append({"name": name, "kind": "class", "line": line(m.start("name")), "signature": f"const {name}", "visibility": "pub" if exported else "priv", "_at": m.start()})
                for key, place, found in members:
                    function(key, place, found, True, name)
        else:
            found = _function(code, wrap.end() if wrap else at, round_, curly)
            if found:
                function(name, m.start("name"), found, exported, None, props and props[1], wrap and wrap[1].split(".")[-1])
    return out
