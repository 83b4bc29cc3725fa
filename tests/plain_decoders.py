"""Record-by-record decoders, the brute force that the structural indexes are compared with."""

import json

from waymesh.functions.markup import whole_number, xml_elements


class Raw(str):
    """The text of a JSON number, as it stands."""


def _no_constant(text):
    raise ValueError(text)


DECODER = json.JSONDecoder(parse_int=Raw, parse_float=Raw, parse_constant=_no_constant)


def json_text(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False)


def _some(value):
    return value if isinstance(value, list) else [] if value is None else [value]


def json_ways(text):
    if text is None:
        return []
    try:
        top = DECODER.decode(text)
    except ValueError:
        return []
    found, stack = [], [top]
    while stack:
        o = stack.pop()
        if isinstance(o, list):
            stack.extend(reversed(o))
        elif isinstance(o, dict):
            stack.extend(reversed([v for v in o.values() if isinstance(v, (dict, list))]))
            if o.get("type") == "way" and not isinstance(o.get("type"), Raw):
                refs = [json_text(x.get("ref") if isinstance(x, dict) else x) for form in ("nodes", "nd") for x in _some(o.get(form))]
                tags = [(k, json_text(v)) for k, v in o["tags"].items()] if isinstance(o.get("tags"), dict) else []
                for x in [*_some(o.get("tag")), *(o["tags"] if isinstance(o.get("tags"), list) else [])]:
                    if isinstance(x, dict) and x.get("k") is not None:
                        tags.append((json_text(x["k"]), json_text(x.get("v"))))
                found.append((whole_number(json_text(o.get("id"))), refs, tags))
    return found


def xml_nodes(text):
    return [(whole_number(attrs.get("id")), [], tags) for attrs, tags in xml_elements(text)]
