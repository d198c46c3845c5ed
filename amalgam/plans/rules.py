"""Match-rule documents: parsing, repair, defaults, edits, and the offline providers."""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

RANK = {"automatic": 0, "suspect": 1}
RANK_DEMOTED, RANK_OTHER = 2, 9
_SUPPORTED = {"exact", "fuzzy", "exactOrNull"}
#: Keys that belong inside a rule, and names to be read as others.
RULE_KEYS = ("weights", "comparators", "comparatorClasses", "matchTokenClasses", "matchTokens", "actionThresholds", "and", "or", "exact", "fuzzy", "ignoreInToken", "cleanse")
RENAMED = {"comparators": "comparatorClasses", "matchTokens": "matchTokenClasses"}


def column_of(uri: str) -> str:
    """The last segment of an attribute path."""
    return uri.rstrip("/").split("/")[-1]


@dataclass(frozen=True)
class Rule:
    uri: str
    label: str
    type: str
    scope: str = "ALL"
    exact: tuple[str, ...] = ()
    fuzzy: tuple[str, ...] = ()
    exact_or_null: tuple[str, ...] = ()
    weights: tuple[str, ...] = ()
    not_exact_same: tuple[str, ...] = ()
    negative: bool = False

    @property
    def rank(self) -> int:
        return RANK.get(self.type, RANK_OTHER)

    def on(self, columns: list[str]) -> "Rule":
        """The rule without columns that the table lacks; what is dropped makes the rule broader, so it warns."""
        lost = [c for c in (*self.exact, *self.fuzzy, *self.exact_or_null, *self.not_exact_same, *self.weights) if c not in columns]
        if lost:
            warnings.warn(f"{self.uri}: columns not in the table are ignored: {', '.join(lost)}", stacklevel=2)
        keep = lambda cs: tuple(c for c in cs if c in columns)
        return Rule(self.uri, self.label, self.type, self.scope, keep(self.exact), keep(self.fuzzy), keep(self.exact_or_null), keep(self.weights), keep(self.not_exact_same), self.negative)


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)

    @property
    def positive(self) -> list[Rule]:
        return [r for r in self.rules if not r.negative]

    @property
    def negative_columns(self) -> list[str]:
        return list(dict.fromkeys(c for r in self.rules if r.negative for c in r.not_exact_same))


def parse(document: dict) -> RuleSet:
    """Typed rules of a document; operands that nothing executes are named in a warning."""
    out = RuleSet()
    for g in document.get("matchGroups", []):
        negative = "negativeRule" in g
        body = g.get("negativeRule" if negative else "rule", {})
        clause = body.get("and", {})
        unknown = [k for k in (*clause, *[k for k in body if k == "or"]) if k not in _SUPPORTED and not (negative and k == "notExactSame")]
        if unknown:
            warnings.warn(f"{g.get('uri', '?')}: operands not supported: {', '.join(unknown)}", stacklevel=2)
        names = lambda k: tuple(column_of(u) for u in clause.get(k, []))  # noqa: E731, B023
        uri = g.get("uri", "")
        out.rules.append(Rule(uri, g.get("label", column_of(uri)), g.get("type", "suspect"), g.get("scope", "ALL"), names("exact"), names("fuzzy"), names("exactOrNull"), tuple(column_of(w["attribute"]) for w in body.get("weights", []) if w.get("attribute")), names("notExactSame"), negative))
    return out


#: What a rule's group holds unless it says otherwise; a negative one holds the scope only.
GROUP_DEFAULTS = {"scope": "ALL", "useOvOnly": "true", "scoreStandalone": 0, "scoreIncremental": 0}
NEGATIVE_DEFAULTS = {"scope": "ALL"}
#: What names of groups begin with, in paths and in labels.
PATH_PREFIX = {False: "MatchOn", True: "NegativeRuleOn"}
LABEL_PREFIX = {False: "Match on ", True: "Negative Rule - "}


def _camel_words(slug: str) -> list[str]:
    """The words of a slug: a capital starts one after a small letter, and before one after a capital."""
    words: list[str] = []
    for before, c, after in zip(" " + slug, slug, slug[1:] + " "):
        starts = c.isupper() and (before.islower() or (before.isupper() and after.islower()))
        if starts or not words:
            words.append(c)
        else:
            words[-1] += c
    return words


def _path_of(group: dict, entity: str, negative: bool) -> str:
    slug = "".join(filter(str.isalnum, group["label"].title()))
    return "/".join(("configuration", "entityTypes", "".join(entity.split(" ")), "matchGroups", PATH_PREFIX[negative] + "".join(c for c in slug if c.isascii())))


def _label_of(group: dict, entity: str, negative: bool) -> str:
    slug = column_of(group["uri"])
    for prefix in PATH_PREFIX.values():
        if slug.startswith(prefix):
            slug = slug[len(prefix) :]
            break
    return LABEL_PREFIX[negative] + " ".join(_camel_words(slug))


#: Names that a group can lack, and how each follows from the other.
_DERIVED = {"uri": ("label", _path_of), "label": ("uri", _label_of)}


def _body_of(group: dict) -> tuple[dict, dict]:
    """A group without the keys that belong into its rule, and the rule that they make."""
    body = {k: v for k, v in group.items() if k in RULE_KEYS}
    if not body:
        raise ValueError(f"group {group['uri']} has no rule")
    named = {RENAMED[k] if k in RENAMED and RENAMED[k] not in body else k: v for k, v in body.items()}
    return {k: v for k, v in group.items() if k not in body}, named


def normalise(document: dict, entity: str) -> dict:
    """A document with names, rule bodies and defaults in place; ValueError where nothing can be repaired."""
    given = document.get("matchGroups")
    if not isinstance(given, list):
        raise ValueError("the document needs a list 'matchGroups'")

    def mended(group: dict) -> dict:
        negative = "negativeRule" in group
        missing = [name for name in _DERIVED if name not in group]
        if len(missing) == len(_DERIVED):
            raise ValueError(f"a group has neither uri nor label; its keys: {sorted(group)}")
        out = {**group, **{name: _DERIVED[name][1](group, entity, negative) for name in missing}}
        if negative:
            return {**NEGATIVE_DEFAULTS, **out}
        if "rule" not in out:
            out, body = _body_of(out)
            out["rule"] = body
        return {**GROUP_DEFAULTS, **out}

    return {**document, "matchGroups": [mended(g) for g in given]}


#: Phrases of each edit, tried in this order.
EDITS = (
    ("relevance", ("remove relevance", "delete relevance", "no relevance")),
    ("negative", ("remove negative", "disable negative", "no negative")),
    ("suspect", ("remove suspect", "delete suspect", "no suspect")),
    ("list", ("how many", "what rules", "list rules", "show rules")),
    ("internal", ("scope internal", "set scope internal")),
    ("all", ("scope all", "set scope all")),
)


#: Groups that an edit takes out.
_TAKEN_OUT = {"relevance": lambda g: g.get("type") == "relevance_based", "negative": lambda g: "negativeRule" in g, "suspect": lambda g: g.get("type") == "suspect"}


def edit(document: dict, instruction: str) -> tuple[dict, str]:
    """The edited document and a reply; an instruction without a known phrase changes nothing."""
    said, groups = instruction.strip().lower(), document.get("matchGroups", [])
    what = next((name for name, phrases in EDITS if any(p in said for p in phrases)), None)
    if what is None:
        return document, "nothing done: say one of " + " | ".join(phrases[0] for _, phrases in EDITS)
    if what == "list":
        return document, "\n".join([f"rules: {len(groups)}", *(g.get("label") or g.get("uri", "unnamed") for g in groups)])
    if what in _TAKEN_OUT:
        kept = [g for g in groups if not _TAKEN_OUT[what](g)]
        reply = f"{what}: {len(groups) - len(kept)} out, {len(kept)} left"
    else:
        kept = [{**g, "scope": what.upper()} for g in groups]
        reply = f"scope is {what.upper()} in {len(kept)}"
    return {**document, "matchGroups": kept}, reply


def newest_first(history: list) -> list:
    """Instructions and replies for display."""
    return history[::-1]


def tallies(document: dict) -> dict[str, int]:
    groups = document.get("matchGroups", [])
    kind = lambda t: sum(g.get("type") == t for g in groups)
    return {"automatic": kind("automatic"), "suspect": kind("suspect"), "relevance_based": kind("relevance_based"), "negative": sum("negativeRule" in g for g in groups)}


def strip_fences(text: str) -> str:
    text = text.strip()
    m = re.match(r"^```[A-Za-z]*\s*(.*?)\s*(?:```|$)", text, re.S)
    return m.group(1) if m else text


def clean_json(text: str) -> str:
    """Mend smart quotes, Python literals, trailing commas, raw line ends in strings, and open brackets."""
    text = strip_fences(text).translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})
    out, stack, inside, escaped = [], [], False, False
    i = 0
    while i < len(text):
        c = text[i]
        if inside:
            if c in "\r\n":
                out.append("\\n" if c == "\n" else "")
            else:
                out.append(c)
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            i += 1
            continue
        literal = re.match(r"(True|False|None)\b", text[i:])
        if literal and not (out and (out[-1][-1].isalnum() or out[-1][-1] == "_")):
            out.append({"True": "true", "False": "false", "None": "null"}[literal.group()])
            i += len(literal.group())
            continue
        if c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            while out and out[-1].isspace():
                out.pop()
            if out and out[-1] == ",":
                out.pop()
            if stack:
                stack.pop()
        out.append(c)
        i += 1
    mended = "".join(out) + ('"' if inside else "")
    if stack:
        mended = mended.rstrip().rstrip(",") + "".join(reversed(stack))
    return mended


def parse_json(text: str, repair=None) -> dict:
    """The document in a text: as it is, mended, its outermost braces, or by `repair(text)`; else ValueError."""
    mended = clean_json(text)
    tries = [mended]
    if "{" in mended:
        tries.append(mended[mended.index("{") : mended.rindex("}") + 1 if "}" in mended else None])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    if repair is not None:
        return json.loads(clean_json(repair(text)))
    raise ValueError("the text holds no JSON document")


#: Verdicts in order of precedence, with the confidence of one that is only read from a text.
VERDICTS = {"MATCH": 0.8, "SUSPECT": 0.6, "NO_MATCH": 0.5}


def parse_verdict(text: str) -> dict:
    """An adjudicator's answer: a JSON object with a verdict, or else the verdicts that its text names.

    NO_MATCH in a text rules MATCH out; a text that names none is NO_MATCH, an object without one SUSPECT.
    """
    body = strip_fences(text)
    try:
        found = json.loads(body)
    except (ValueError, TypeError):
        named = set(re.findall("NO_MATCH|MATCH|SUSPECT", body))
        if "NO_MATCH" in named:
            named.discard("MATCH")
        verdict = next((v for v in VERDICTS if v in named), None)
        return {"verdict": verdict or "NO_MATCH", "confidence": VERDICTS[verdict or "NO_MATCH"], "reasoning": "read from the text" if verdict and verdict != "NO_MATCH" else "not readable"}
    if isinstance(found, dict) and "verdict" in found:
        return found
    return {"verdict": "SUSPECT", "confidence": 0.5, "reasoning": "no verdict given"}
