"""SQL counterpart of the word stems: the published algorithm as a chain of CTEs over distinct words."""

from __future__ import annotations

from sparkfolio.functions.stem import _STEP2, _STEP3, _STEP4

# V and C per letter; y is a vowel after a consonant, resolved from the left (runs of up to seven).
_SHAPE = "regexp_replace(translate(w, 'aeioubcdfghjklmnpqrstvwxz', 'VVVVVCCCCCCCCCCCCCCCCCCCC'), '^y', 'C')"
for _ in range(3):
    _SHAPE = f"replace(replace({_SHAPE}, 'Cy', 'CV'), 'Vy', 'VC')"


def _cut(n: int, of: str = "w") -> str:
    return f"substring({of}, 1, length({of}) - {n})"


def _measure(n: int = 0) -> str:
    """Measure of the word without its last ``n`` letters (the shape of a beginning is the beginning of the shape)."""
    return f"len(regexp_extract_all({_cut(n, 's')}, 'V+C+'))"


def _vowel(n: int) -> str:
    return f"contains({_cut(n, 's')}, 'V')"


def _cvc(n: int) -> str:
    return f"({_cut(n, 's')} LIKE '%CVC' AND NOT regexp_matches({_cut(n)}, '[wxy]$'))"


_DOUBLE = "(length(w) >= 2 AND right(w, 1) = substring(w, length(w) - 1, 1) AND right(s, 1) = 'C')"


def _table(endings: dict[str, str], extra: dict[str, str] | None = None, least: int = 1) -> str:
    """The longest ending that fits decides; it is replaced where the rest is long enough."""
    whens = []
    for old in sorted(endings, key=len, reverse=True):
        more = (extra or {}).get(old, "")
        whens.append(f"WHEN ends_with(w, '{old}') THEN CASE WHEN {_measure(len(old))} >= {least}{more} THEN {_cut(len(old))} || '{endings[old]}' ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


_RULES = [
    f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut(1)} ELSE w END",
    # A cut ending leaves a mark that the next rule takes away again.
    f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(3)} > 0 THEN {_cut(1)} ELSE w END
  WHEN ends_with(w, 'ed') AND {_vowel(2)} THEN {_cut(2)} || '+' WHEN ends_with(w, 'ing') AND {_vowel(3)} THEN {_cut(3)} || '+' ELSE w END""",
    None,  # what follows a cut, see _AFTER_CUT
    f"CASE WHEN ends_with(w, 'y') AND {_vowel(1)} THEN {_cut(1)} || 'i' ELSE w END",
    _table(_STEP2),
    _table(_STEP3),
    _table(dict.fromkeys(_STEP4, ""), {"ion": " AND regexp_matches(w, '[st]ion$')"}, 2),
    f"CASE WHEN ends_with(w, 'e') AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT {_cvc(1)})) THEN {_cut(1)} ELSE w END",
    f"CASE WHEN {_measure()} > 1 AND {_DOUBLE} AND ends_with(w, 'l') THEN {_cut(1)} ELSE w END",
]
_AFTER_CUT = (f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {_DOUBLE} AND NOT regexp_matches(w, '[lsz]$') THEN {_cut(1)} "
              f"WHEN {_measure()} = 1 AND {_cvc(0)} THEN w || 'e' ELSE w END")


def stems_sql(words: str) -> str:
    """CTEs ending in ``stems`` (term, stem) of the query ``words``, which gives one column ``term``."""
    ctes = [f"st0 AS (SELECT term, term AS w FROM ({words}) WHERE length(term) > 2 AND regexp_full_match(term, '[a-z]+'))"]
    for k, rule in enumerate(_RULES):
        if rule is None:
            inner = f"SELECT term, marked, {_AFTER_CUT} AS fixed, w FROM (SELECT *, {_SHAPE} AS s FROM (SELECT term, ends_with(w, '+') AS marked, rtrim(w, '+') AS w FROM st{k}))"
            ctes.append(f"st{k + 1} AS (SELECT term, CASE WHEN marked THEN fixed ELSE w END AS w FROM ({inner}))")
        else:
            ctes.append(f"st{k + 1} AS (SELECT term, {rule} AS w FROM (SELECT *, {_SHAPE} AS s FROM st{k}))")
    ctes.append(f"stems AS (SELECT term, w AS stem FROM st{len(_RULES)} UNION ALL SELECT term, term FROM ({words}) WHERE NOT (length(term) > 2 AND regexp_full_match(term, '[a-z]+')))")
    return ", ".join(ctes)
