"""Classification codes: rules of exact codes, prefixes and ranges."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as lx
from quillspark.functions.proximity import terms_regex


@dataclass(frozen=True)
class CodeRules:
    """Codes that belong to a block. A range is (head, low, high) of the part behind the slash, compared zero-padded."""

    exact: tuple[str, ...] = ()
    prefix: tuple[str, ...] = ()
    range: tuple[tuple[str, str, str], ...] = field(default=())

    @classmethod
    def parse(cls, lines: str) -> CodeRules:
        """From search text: `A/1` exact, `A+` prefix, `A/1:A/9` range; a range over two groups gives its two ends as prefixes."""
        exact, prefix, ranges = [], [], []
        for item in lines.replace(",", " ").split():
            if ":" in item:
                (h1, lo), (h2, hi) = (x.split("/", 1) for x in item.split(":"))
                if h1 == h2:
                    ranges.append((h1, lo, hi))
                else:
                    prefix += [f"{h1}/", f"{h2}/"]
            elif item.endswith("+"):
                prefix.append(item[:-1])
            else:
                exact.append(item)
        return cls(tuple(exact), tuple(prefix), tuple(ranges))

    def matches(self, code: Column) -> Column:
        head, sub = F.split_part(code, F.lit("/"), F.lit(1)), F.substr(code, F.instr(code, "/") + 1)
        tests = [code.isin(*self.exact)] if self.exact else []
        tests += [code.startswith(p) for p in self.prefix]
        tests += [code.contains("/") & (head == h) & _not_below(sub, F.lit(lo)) & _not_below(F.lit(hi), sub) for h, lo, hi in self.range]
        return reduce(or_, tests, F.lit(False))


def _not_below(a: Column, b: Column) -> Column:
    """a >= b as strings, the shorter one padded with zeros."""
    n = F.greatest(F.length(a), F.length(b))
    return F.rpad(a, n, F.lit("0")) >= F.rpad(b, n, F.lit("0"))


def any_prefix(code: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, [code.startswith(p) for p in prefixes])


def field_label(codes: Column) -> Column:
    """The first field with a code among codes, else other."""
    label = F.lit("other")
    for name, prefixes in reversed(lx.FIELDS):
        label = F.when(F.exists(codes, _has(prefixes)), name).otherwise(label)
    return label


def _has(prefixes: tuple[str, ...]):  # noqa: ANN202
    return lambda c: any_prefix(c, prefixes)


def successor_allowed(old: Column, new: Column) -> Column:
    """Whether new is among the successors of the first rule that fits old."""
    ok = F.lit(False)
    for prefix, targets in reversed(lx.SUCCESSORS):
        ok = F.when(old.startswith(prefix), any_prefix(new, targets)).otherwise(ok)
    return ok


def build_rules(blocks: dict[str, str], terms: dict[str, list[str]]) -> dict[str, dict]:
    """A rule set for a configuration file: search text of code blocks and lists of search terms, compiled."""
    rules: dict[str, dict] = {}
    for name, text in blocks.items():
        r = CodeRules.parse(text)
        rules[name] = {"exact": sorted(set(r.exact)), "prefix": sorted(set(r.prefix)), "range": [list(x) for x in r.range]}
    return rules | {name: {"terms": lines, "pattern": terms_regex(lines)} for name, lines in terms.items()}


def rules_of(config: dict, name: str) -> CodeRules:
    """A block of a rule set read back."""
    c = config[name]
    return CodeRules(tuple(c["exact"]), tuple(c["prefix"]), tuple((h, lo, hi) for h, lo, hi in c["range"]))
