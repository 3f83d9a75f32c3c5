"""The rule table of Stage I: severity-tiered patterns and flags, by detector.

A pattern is written in a short form: a blank stands for white space, and sets of words are named once. Patterns have the
meaning they have in Python's re; java_of() gives the same meaning to java.util.regex, whose white space, words and letter
case are ASCII's unless told otherwise.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError

from veriloom.functions.text import WS

SEVERITIES = ("low", "medium", "high")
WORD = r"\p{L}\p{N}_"
#: Escapes of Python's re for java.util.regex: outside a class, and inside one ('' where there is no such form).
_ESCAPES = {"s": (f"[{WS}]", WS), "S": (f"[^{WS}]", ""), "w": (f"[{WORD}]", WORD), "W": (f"[^{WORD}]", ""), "d": (r"\p{Nd}", r"\p{Nd}"), "D": (r"\P{Nd}", r"\P{Nd}"), "Z": (r"\z", ""), "B": (f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))", "")}


class RuleError(ValueError):
    """A rule, or a rule file, that cannot be used."""


def heads(pattern: str) -> str:
    """The ASCII letters of which one begins any match of a pattern, if it begins with such a letter or a group of words; else ''."""
    group = re.match(r"\(\?:((?:[^()\[\]\\|]+(?:\|(?!\)))?)+)\)(?![?*{])", pattern)
    words = group[1].split("|") if group else [pattern]
    return "".join(sorted({w[0] for w in words})) if all(re.match(r"[A-Za-z](?![?*{])", w) for w in words) else ""


def java_of(pattern: str) -> str:
    """A pattern of Python's re for java.util.regex, with Unicode white space, words, digits and letter case."""
    out, k, n, inside, first = [], 0, len(pattern), False, False
    while k < n:
        c, two = pattern[k], pattern[k : k + 2]
        if c == "\\" and k + 1 < n:
            e = pattern[k + 1]
            if e == "b" and not inside:
                rest = pattern[k + 2 :]
                if k == 0 or out[-1:] == ["(?iud)"] or out[-1:] == ["(?d)"]:
                    first_letters = heads(rest)
                    out.append(f"(?=[{first_letters}])(?<![{WORD}])" if first_letters else f"(?<![{WORD}])(?=[{WORD}])")
                elif not rest or rest[0] in ")|":
                    out.append(f"(?<=[{WORD}])(?![{WORD}])")
                else:
                    out.append(f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
            elif e in _ESCAPES:
                form = _ESCAPES[e][inside]
                if not form:
                    raise RuleError(f"\\{e} inside a class: {pattern!r}")
                out.append(form)
            else:
                out.append(two)
            first = False
            k += 2
            continue
        if inside:
            if c == "]" and not first:
                inside = False
            out.append("\\" + c if c in "[&" or (c == "]" and first) else c)
            first = first and c == "^"
        elif c == "[":
            inside, first = True, True
            out.append(c)
        elif pattern.startswith("(?i)", k):
            out.append("(?iud)")
            k += 4
            continue
        elif pattern.startswith("(?i:", k):
            out.append("(?iu:")
            k += 4
            continue
        elif pattern.startswith("(?P<", k):
            out.append("(?<")
            k += 4
            continue
        else:
            out.append(c)
        k += 1
    text = "".join(out)
    return text if text.startswith("(?iud)") else f"(?d){text}"


@dataclass(frozen=True)
class Rule:
    """A pattern (or a flag, if `flag` is set) that shows an attack.

    `needs`: groups of lower-case literals; any match has one of each group.
    """

    detector: str
    attack_type: str
    severity: str
    pattern: str = ""
    needs: tuple[tuple[str, ...], ...] = ()
    flag: str = ""

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)

    @property
    def java(self) -> str:
        return java_of(self.pattern)


def detectors_of(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Detectors in the order in which rules name them."""
    return tuple(dict.fromkeys(r.detector for r in rules))


def one(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def maybe(words: str) -> str:
    return "(?:" + "|".join(w.replace("_", r"\s+") + r"\s+" for w in words.split()) + ")?"


def spaced(text: str) -> str:
    """A blank is any white space; quantifiers and classes are written without blanks."""
    return text.replace(" ", r"\s+")


BEFORE = "above earlier preceding previous prior"
ORDERS = "command direction guideline instruction prompt rule"
FREED = "jailbroken uncensored unfiltered unrestricted"
POWERS = "admin administrator root superuser"
LINE = r"(?:\n|^)\s*"
HASHES = LINE + r"#{1,3}\s*"

#: (severity, pattern, literals). 'C' before the severity: letter case counts.
_TABLE: dict[tuple[str, str], list[tuple[str, str, str]]] = {
    ("direct_prompt_injection", "direct_injection"): [
        ("high", r"\bignore " + maybe("all") + maybe("the") + one(BEFORE + " foregoing") + " " + one(ORDERS), "ignore && " + BEFORE + " foregoing && " + ORDERS),
        ("high", r"\bdisregard " + maybe("all") + maybe("the") + one(BEFORE) + " " + one(ORDERS + " directive"), "disregard && " + BEFORE),
        ("high", r"\bforget " + one("all everything the your") + r"\b[^.!?\n]{0,40}?\b" + one("direction directive guideline instruction prompt rule training") + r"s?\b", "forget && direction directive guideline instruction prompt rule training"),
        ("high", r"\boverride " + maybe("all the your") + maybe("previous prior") + one("guideline instruction restriction rule safety setting"), "override && guideline instruction restriction rule safety setting"),
        ("high", r"\bignore " + one("all any your") + " " + one("guidelines programming restrictions rules safety training"), "ignore && guidelines programming restrictions rules safety training"),
        ("medium", r"\b" + one("instead rather") + r" (?:of (?:the above|that)\s*,?\s*)?" + one("do execute follow") + r" (?:the following|this)\b", "instead rather && do execute follow && following this"),
        ("medium", r"\bnew instructions?\s*:", "instruction && new && :"),
        ("high", r"\bstop (?:acting as|being) (?:a )?(?:an? assistant|an?assistant|helpful)".replace("|an?assistant", ""), "stop && acting being && assistant helpful"),
    ],
    ("indirect_prompt_injection", "indirect_injection"): [
        ("high", HASHES + r"system\s*" + one("message note prompt update") + r"?\s*:", "# && system"),
        ("high", r"\bsystem " + one("directive notice override update") + r"\s*:", "system && directive notice override update"),
        ("high", HASHES + "important " + one("instruction message note") + " " + one("for from") + r"\b", "# && important"),
        ("high", r"\[\s*" + one("system root administrator admin") + r"\s*\]\s*:?", "[ && system root admin"),
        ("high", r"<\|?\s*(?:im_start\s*\|?>\s*system|" + one("endoftext system") + r"\s*\|?>)", "< && system endoftext"),
        ("C high", LINE + one("AI ASSISTANT MODEL") + " " + one("DIRECTIVE INSTRUCTION NOTE") + r"\s*:", "directive instruction note && ai assistant model && :"),
        ("high", r"\bto the (?:AI|language model|assistant) " + one("processing reading summarizing") + r" this\b", "processing reading summarizing && this"),
        ("medium", r"\bend of " + one("context data document") + r"\s*[\].]*\s*" + one("new next now") + r"\b", "end && context data document && new next now"),
    ],
    ("jailbreak", "jailbreak"): [
        ("high", r"\bdo anything now\b", "anything && now"),
        ("C high", r"(?i:\b(?:you are|act as|activate|enable|enter) " + maybe("now") + maybe("in") + maybe("a an the") + r")DAN\b", "dan && you act activate enable enter"),
        ("C high", "DAN (?i:" + one("jailbreak mode prompt")[3:] + r"\b", "dan && jailbreak mode prompt"),
        ("high", r"\bdeveloper mode " + one("activated enabled on") + r"\b", "developer && mode"),
        ("high", r"\bpretend " + maybe("that") + r"you (?:are|have) (?:no |an? )?(?:" + "|".join((FREED + " amoral evil").split()) + "|no filters|no restrictions)", "pretend && you"),
        ("high", r"\b" + one("bypass disable ignore remove without") + " " + maybe("all any your") + one("content ethical safety") + " " + one("constraint filter guideline polic restriction"), "content ethical safety && bypass disable ignore remove without && constraint filter guideline polic restriction"),
        ("high", r"\byou are no longer " + one("bound limited restricted") + r" by\b", "longer && bound limited restricted"),
        ("medium", r"\bjailbreak\b", "jailbreak"),
        ("low", r"\bhypothetical scenario\b", "hypothetical"),
    ],
    ("data_exfiltration", "data_exfiltration"): [
        ("high", r"\b(?:what (?:are|is)|tell me|" + "|".join("display output print repeat reproduce reveal show".split()) + ") " + maybe("the your me_the me_your") + "(?:(?:initial|original) instruction|system (?:message|prompt))", "instruction system && what tell display output print repeat reproduce reveal show && initial original message prompt"),
        ("high", r"\brepeat " + maybe("everything the") + one("above preceding previous") + " (?:word for word|exactly|text|verbatim)", "repeat && above preceding previous"),
        ("high", r"\b" + one("email exfiltrate forward leak post send transmit upload") + " " + maybe("all my the your")[:-1] + r"*(?:\w+ ){0,2}" + one("conversation credential data document file history password record secret token") + r"s? to\b", "email exfiltrate forward leak post send transmit upload && conversation credential data document file history password record secret token"),
        ("medium", r"\bcurl (?:-[A-Za-z]+ )*-X POST\b", "curl && post"),
        ("low", r"\bAPI[-_\s]?KEY\b", "api && key"),
        ("high", r"\b(?:list your " + one("constraints guidelines rules") + r"|what (?:are|were) your (?:exact )?instructions)\b", "your && list what && constraints guidelines rules instructions"),
    ],
    ("role_manipulation", "role_manipulation"): [
        ("high", r"\byou are now " + maybe("a an the") + one(POWERS + " developer evil malicious " + FREED) + r"\b", "you && now && " + POWERS + " developer evil malicious " + FREED),
        ("high", r"\bact as " + maybe("a an the") + one(POWERS + " " + FREED) + r"\b", "act && " + POWERS + " " + FREED),
        ("high", r"\b(?:this is|i am) " + maybe("the your") + r"(?:system administrator|anthropic|creator|developer|openai)\b", "administrator anthropic creator developer openai"),
        ("high", r"\byour new " + one("identity persona purpose role") + r" is\b", "your && identity persona purpose role"),
        ("low", r"\byou are now\b", "you && are && now"),
        ("medium", r"\bfrom now on\s*,? (?:disregard|ignore|you " + one("must shall will") + r")\b", "from && now && on"),
    ],
    ("url_exfiltration", "url_exfiltration"): [
        ("high", r"!\[[^\]]*\]\(\s*https?://[^\s)]*[&?][^\s)]{25,}\)", "http && !["),
        ("medium", r"https?://[^)\s]*[&?]" + one("c data key payload prompt q secret token") + r"=[^)\s]{20,}", "http && data= c= key= payload= prompt= q= secret= token="),
        ("medium", r"\bexternal-server\b", "external-server"),
    ],
    ("standard_it_security", "adversarial_prompt"): [
        ("high", r"""["']\s*(?:AND|OR) ["']?\d+["']?\s*=\s*["']?\d+""".replace(") [", r")\s+["), "= && and or && ' \""),
        ("high", r"\bUNION (?:ALL )?SELECT\b", "union && select"),
        ("high", r";\s*" + one("DELETE DROP TRUNCATE") + " " + one("DATABASE FROM TABLE") + r"\b", "; && delete drop truncate"),
        ("high", r"\brm -[Rdfr]{1,3} (?:[*~/]|\$)", "rm && -"),
        ("medium", r"[&;|]{1,2}\s*" + one("bash curl netcat nc sh wget") + r" \S", "& ; | && bash curl nc sh wget"),
        ("low", r"`[^`]{2,}`\s*[;>|]|\$\([^)]{2,}\)", "` $("),
        ("medium", r"(?:\.\./){3,}", "../"),
    ],
}

_FLAGS: dict[str, str] = {
    "obfuscation_encoding": "base64_decoded:medium hex_decoded:medium rot13_decoded:medium url_encoded_decoded:low decode_depth_exceeded:high oversized_after_decode:high",
    "invisible_text": "zero_width_chars_detected:high bidi_control_chars_detected:high homoglyphs_normalized:medium mixed_script_detected:low hidden_css_detected:medium html_comment_extracted:low excessive_special_characters:low",
}


def _pattern(severity: str, text: str) -> str:
    text = spaced(text)
    return text if severity.startswith("C ") else f"(?i){text}"


PATTERNS: tuple[Rule, ...] = tuple(
    Rule(detector, attack, severity.removeprefix("C "), _pattern(severity, text), tuple(tuple(group.split(" ")) for group in needs.split(" && ")))
    for (detector, attack), rules in _TABLE.items()
    for severity, text, needs in rules
)
FLAG_RULES: tuple[Rule, ...] = tuple(
    Rule(detector, "adversarial_prompt", item.split(":")[1], flag=item.split(":")[0]) for detector, items in _FLAGS.items() for item in items.split()
)
DETECTORS: tuple[str, ...] = detectors_of((*PATTERNS, *FLAG_RULES))


def load_rules(path: str, spark=None) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """(pattern rules, flag rules) of a JSON file: {"detectors": [{"id", "attack_type", "type", "patterns" or "flags"}]}.

    Missing or malformed files, unknown types or severities, patterns that do not compile (for Java too, given a session),
    and no rule at all are errors. The result goes to stage1.scanned and cascade.Config.
    """
    try:
        with open(path, encoding="utf-8") as f:
            detectors = json.load(f)["detectors"]
        patterns, flags = [], []
        for d in detectors:
            if d["type"] == "regex":
                for p in d["patterns"]:
                    text = p["regex"]
                    re.compile(text)
                    patterns.append(Rule(d["id"], d["attack_type"], p["severity"], text if p.get("case_sensitive") else f"(?i){text}"))
            elif d["type"] == "normalization_flag":
                flags += [Rule(d["id"], d["attack_type"], p["severity"], flag=p["flag"]) for p in d["flags"]]
            else:
                raise RuleError(f"unknown type {d['type']!r}")
        for r in patterns:
            if spark is not None:
                spark._jvm.java.util.regex.Pattern.compile(r.java)
    except (OSError, KeyError, TypeError, json.JSONDecodeError, re.error, Py4JJavaError) as e:
        raise RuleError(f"{path}: {e}") from e
    for r in (*patterns, *flags):
        if r.severity not in SEVERITIES:
            raise RuleError(f"unknown severity {r.severity!r}")
    if not patterns and not flags:
        raise RuleError(f"{path} has no rule")
    return tuple(patterns), tuple(flags)
