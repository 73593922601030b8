"""SQL twins of the text expressions, for the checking engine.

Its regular expressions have no look-around and no back references, so the
rules are restated on runs of word characters.
"""

from __future__ import annotations

RUN = r"[\p{L}\p{N}_-]+"
WORDS = r"[\p{L}\p{N}_]+"


def q(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def strip(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def tokens(x):
    return f"regexp_extract_all(lower({x}), '{WORDS}')"


def numbers(x):
    return (
        rf"list_transform(regexp_extract_all({x}, '\p{{Nd}}+(?:[ \x{{00a0}}\x{{202f}}]\p{{Nd}}{{3}})*(?:[.,]\p{{Nd}}+)?'), "
        rf"lambda n: regexp_replace(replace(regexp_replace(n, '[ \x{{00a0}}\x{{202f}}]', '', 'g'), ',', '.'), '\.+$', ''))"
    )


def acronyms(x):
    return f"list_filter(regexp_extract_all({x}, '{RUN}'), lambda r: regexp_full_match(r, '[A-ZÀ-ÖØ-Þ]{{2,}}'))"


def strip_fillers(x, fillers):
    marked = rf"regexp_replace({x}, '({RUN})', chr(1) || '\1' || chr(2), 'g')"
    out = rf"regexp_replace({marked}, '(?i)\x01(?:{'|'.join(fillers)})\x02\s*,?\s*', '', 'g')"
    return rf"regexp_replace({out}, '[\x01\x02]', '', 'g')"


def collapse_repeats(x, doubles):
    toks, seps = f"regexp_extract_all({x}, '{RUN}')", f"regexp_split_to_array({x}, '{RUN}')"
    return f"""(SELECT CASE WHEN len(tk) = 0 THEN {x} ELSE
        sp[1] || tk[1] || array_to_string(list_transform(list_filter(range(2, len(tk) + 1),
          lambda i: NOT (lower(tk[i]) = lower(tk[i-1]) AND regexp_full_match(sp[i], '\\s+') AND NOT contains(tk[i], '-')
                         AND lower(tk[i]) NOT IN ({q(doubles)}))), lambda i: sp[i] || tk[i]), '') || sp[len(sp)] END
        FROM (SELECT {toks} AS tk, {seps} AS sp))"""


def fix_typography(x):
    out = x
    for pattern, new in (
        (r"[ \t]{2,}", "' '"), (r"\s+([,.])", r"'\1'"), (r"\s*([;:!?»])", r"' \1'"), (r"(«)\s*", r"'\1 '"),
        (r"([\p{L}\p{N}_])(«)", r"'\1 \2'"), (r"^\s*[,;:.]\s*", "''"),
        (r"([.!?…]\s+)([a-zà-öø-ÿ])", r"'\1' || chr(1) || '\2'"),
    ):
        out = f"regexp_replace({out}, '{pattern}', {new}, 'g')"
    out = f"array_to_string(list_transform(string_split({out}, chr(1)), lambda p: replace(upper(substring(p, 1, 1)), 'ẞ', 'SS') || substring(p, 2)), '')"
    return strip(out)


def fold(x):
    return f"lower(strip_accents({x}))"


def compare_words(x):
    return f"regexp_extract_all({fold(x)}, '{WORDS}')"


def norm_key(x):
    return rf"regexp_replace(replace({fold(x)}, 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


def norm_title(x):
    return rf"trim(regexp_replace(replace({fold(x)}, 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def match_norm(x):
    return rf"regexp_replace(lower({squeeze(x)}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


def fingerprint(x):
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'))"


def excerpt_at(text, pos):
    """``pos`` is 0-based."""
    start = f"greatest({pos} - 60, 0)"
    body = squeeze(f"substring({text}, ({start} + 1)::BIGINT, 120)")
    return (
        f"CASE WHEN {body} = '' THEN '' ELSE (CASE WHEN {start} > 0 THEN '…' ELSE '' END) || {body} || "
        f"(CASE WHEN {start} + 120 < length({text}) THEN '…' ELSE '' END) END"
    )


def excerpt(x, around=None):
    flat = squeeze(x)
    head = f"substring({flat}, 1, 120) || CASE WHEN length({flat}) > 120 THEN '…' ELSE '' END"
    if around is None:
        return head
    return f"CASE WHEN {around} <> '' AND instr({flat}, {around}) > 0 THEN {excerpt_at(flat, f'(instr({flat}, {around}) - 1)')} ELSE {head} END"


def loop(x):
    w = rf"""regexp_extract_all(lower({x}), '[^\s.,;:!?…«»"()\[\]{{}}]+')"""
    return f"""(SELECT len(list_filter(range(1, 21), lambda k:
        k + k * (CASE WHEN k < 4 THEN 5 ELSE 2 END) <= len(w)
        AND contains(array_to_string(list_transform(range(1, len(w) - k + 1), lambda i: CASE WHEN w[i] = w[i + k] THEN '1' ELSE '0' END), ''),
                     repeat('1', k * (CASE WHEN k < 4 THEN 5 ELSE 2 END))))) > 0
      FROM (SELECT {w} AS w))"""


def timecode(s, sep=","):
    ms = f"round_even(greatest(coalesce({s}, 0), 0) * 1000, 0)::BIGINT"
    pad = lambda e, n: f"CASE WHEN length(({e})::VARCHAR) >= {n} THEN ({e})::VARCHAR ELSE lpad(({e})::VARCHAR, {n}, '0') END"
    return (
        f"(({pad(f'{ms} // 3600000', 2)}) || ':' || ({pad(f'({ms} // 60000) % 60', 2)}) || ':' || "
        f"({pad(f'({ms} // 1000) % 60', 2)}) || '{sep}' || ({pad(f'{ms} % 1000', 3)}))"
    )


def missing_count(left, right, x="x"):
    return f"greatest(len(list_filter({left}, lambda y: y = {x})) - len(list_filter({right}, lambda y: y = {x})), 0)"


def missing_ratio(left, right):
    lost = f"list_sum(list_transform(list_distinct({left}), lambda x: {missing_count(left, right)}))"
    return f"CASE WHEN len({left}) = 0 THEN 0.0::DOUBLE ELSE {lost}::DOUBLE / len({left}) END"


def sensitive(x):
    marked = rf"regexp_replace({x}, '({WORDS})', chr(1) || '\1' || chr(2), 'g')"
    bare = lambda e: rf"list_transform({e}, lambda m: regexp_replace(m, '[\x01\x02]', '', 'g'))"
    nums = bare(rf"regexp_extract_all({marked}, '\x01[0-9]+\x02(?:[.,]\x01[0-9]+\x02)?')")
    caps = bare(rf"regexp_extract_all({marked}, '\x01[A-ZÀ-ÖØ-Þ]{{2,}}\x02(?:-\x01[A-ZÀ-ÖØ-Þ]{{2,}}\x02)*')")
    return f"list_distinct(list_concat({nums}, {caps}))"
