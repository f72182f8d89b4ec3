"""OpenAPI expansion: one Markdown document per operation, references resolved, schemas merged."""

from __future__ import annotations

import hashlib
import json
import re

try:
    import yaml
except ImportError:  # JSON specifications still work
    yaml = None

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
MAX_DEPTH, MAX_OPERATIONS, MAX_LINES = 8, 5000, 2000


class SpecError(ValueError):
    """Not a usable specification."""


def load(text: str) -> dict:
    try:
        spec = json.loads(text)
    except ValueError:
        if yaml is None:
            raise SpecError("only JSON can be read here") from None
        try:
            spec = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise SpecError("neither JSON nor YAML") from e
    if not isinstance(spec, dict) or not isinstance(spec.get("paths"), dict) or not (spec.get("openapi") or spec.get("swagger")):
        raise SpecError("not a specification")
    return spec


def resolve(spec: dict, node, seen: tuple[str, ...] = ()):
    """The target of a local reference; unresolved, remote and cyclic ones become a note."""
    while isinstance(node, dict) and isinstance(node.get("$ref"), str):
        ref = node["$ref"]
        if ref in seen or not ref.startswith("#/"):
            return {"description": f"see {ref.rsplit('/', 1)[-1]}"}
        seen += (ref,)
        node = spec
        for part in ref[2:].split("/"):
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(node, dict) or part not in node:
                return {"description": f"see {part}"}
            node = node[part]
    return node


def merged(spec: dict, schema, depth: int = 0) -> dict:
    """A schema with its reference resolved and allOf parts merged into one object."""
    s = resolve(spec, schema)
    if not isinstance(s, dict):
        return {}
    if depth < MAX_DEPTH and isinstance(s.get("allOf"), list):
        out = {k: v for k, v in s.items() if k != "allOf"}
        out["properties"], out["required"] = dict(out.get("properties") or {}), list(out.get("required") or [])
        for p in s["allOf"]:
            m = merged(spec, p, depth + 1)
            out["properties"] = {**(m.get("properties") or {}), **out["properties"]}
            out["required"] += [x for x in m.get("required") or [] if x not in out["required"]]
            out = {**{k: v for k, v in m.items() if k not in ("properties", "required")}, **out}
        return out
    return s


def fields(spec: dict, schema, depth: int = 0, seen: tuple[str, ...] = ()) -> list[str]:
    """Indented list lines of a schema's properties."""
    ref = schema.get("$ref") if isinstance(schema, dict) else None
    if ref in seen or depth >= MAX_DEPTH:
        return ["  " * depth + f"- (see {str(ref).rsplit('/', 1)[-1]})"] if ref else []
    s = merged(spec, schema)
    seen = (*seen, ref) if ref else seen
    if s.get("type") == "array" or "items" in s:
        return fields(spec, s.get("items") or {}, depth, seen)
    out = []
    for alt in ("oneOf", "anyOf"):
        for i, x in enumerate(s.get(alt) or [], 1):
            out += ["  " * depth + f"- option {i}", *fields(spec, x, depth + 1, seen)]
    for name, p in (s.get("properties") or {}).items():
        q = merged(spec, p)
        kind = q.get("type") or ("object" if "properties" in q else "any")
        if kind == "array":
            kind = f"array of {merged(spec, q.get('items') or {}).get('type', 'object')}"
        need = ", required" if name in (s.get("required") or []) else ""
        text = " ".join(str(q.get("description") or "").split())
        enum = f" One of: {', '.join(map(str, q['enum']))}." if isinstance(q.get("enum"), list) else ""
        out.append("  " * depth + f"- `{name}` ({kind}{need}){': ' + text if text else ''}{enum}")
        out += fields(spec, p, depth + 1, seen)
    return out


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:80] or "operation"


def render(spec: dict, path: str, method: str, op: dict, shared: list) -> str:
    title = " ".join(str(op.get("summary") or op.get("operationId") or f"{method.upper()} {path}").split())
    out = [f"# {title}", "", f"`{method.upper()} {path}`", ""]
    if op.get("deprecated"):
        out += ["**Deprecated.**", ""]
    if op.get("description"):
        out += [str(op["description"]).strip(), ""]
    params: dict[tuple, dict] = {}
    for p in [*shared, *(op.get("parameters") or [])]:
        p = resolve(spec, p)
        if isinstance(p, dict) and p.get("name"):
            params[p.get("in"), p["name"]] = p
    body = {k: v for k, v in params.items() if k[0] == "body"}
    listed = [p for k, p in params.items() if k[0] != "body"]
    if listed:
        out += ["## Parameters", ""]
        for p in listed:
            kind = merged(spec, p.get("schema") or {}).get("type") or p.get("type") or "any"
            out.append(f"- `{p['name']}` ({p.get('in')}, {kind}{', required' if p.get('required') else ''}): {' '.join(str(p.get('description') or '').split())}".rstrip(": "))
        out.append("")
    request = resolve(spec, op.get("requestBody") or {})
    schemas = [(t, (c or {}).get("schema") or {}) for t, c in ((request or {}).get("content") or {}).items()] + [("body", p.get("schema") or {}) for p in body.values()]
    for kind, schema in schemas:
        out += [f"## Request body ({kind})", "", *fields(spec, schema), ""]
    if op.get("responses"):
        out += ["## Responses", ""]
        for code, r in op["responses"].items():
            r = resolve(spec, r)
            if not isinstance(r, dict):
                continue
            out.append(f"### {code}: {' '.join(str(r.get('description') or '').split())}".rstrip(": "))
            out.append("")
            for schema in [*[(c or {}).get("schema") or {} for c in (r.get("content") or {}).values()], *([r["schema"]] if "schema" in r else [])]:
                out += [*fields(spec, schema), ""]
    if len(out) > MAX_LINES:
        out = [*out[:MAX_LINES], "", "(shortened)"]
    return "\n".join(out).strip() + "\n"


def expand(text: str) -> list[tuple[str, str]]:
    """(file name, Markdown) of every operation, in the order of the specification. Names that clash get a digest."""
    spec = load(text)
    found, names = [], {}
    for path, item in spec["paths"].items():
        item = resolve(spec, item)
        if not isinstance(item, dict):
            continue
        for method in METHODS:
            op = item.get(method)
            if isinstance(op, dict):
                if len(found) >= MAX_OPERATIONS:
                    raise SpecError("too many operations")
                name = slug(str(op.get("operationId") or f"{method}-{path}"))
                names[name] = names.get(name, 0) + 1
                found.append((name, f"{method} {path}", render(spec, path, method, op, item.get("parameters") or [])))
    return [(f"{n}-{hashlib.sha256(k.encode()).hexdigest()[:8]}.md" if names[n] > 1 else f"{n}.md", t) for n, k, t in found]
