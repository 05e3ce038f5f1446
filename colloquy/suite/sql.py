"""SQL fragments the checks share. Independent restatements, written for DuckDB."""

from colloquy.functions import lexicon as lx

TURNS = """turns AS (SELECT conv_id*1000+turn AS id, 'u'||conv_id||'-'||turn AS uuid, 'c'||conv_id AS session_id,
 role AS speaker, text, 1736154000000 + conv_id*3600000 + turn*(60000+(conv_id%5)*600000) AS ts,
 CASE conv_id%3 WHEN 0 THEN '' ELSE 'project:'||(conv_id%3) END AS scope FROM conversations)"""

DOC_TURNS = """turns AS (SELECT doc_id AS id, 'd'||doc_id AS uuid, source AS session_id, lang AS speaker, text,
 1736154000000 + doc_id*700000 AS ts, '' AS scope FROM documents)"""


def events(session: str = "user_id%5") -> str:
    return f"""turns AS (SELECT event_id AS id, 's'||({session}) AS session_id, epoch_us(ts)//1000 AS ts,
 list_sort([event_type, 'k'||json_extract_string(props,'$.k')]) AS keys FROM events)"""


def quoted(words: list[str]) -> str:
    return "(" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


STOP = quoted(lx.STOPWORDS)
_WORD = r"[\p{L}\p{N}''\-.$%#/+’]+"


def words(text: str = "text") -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({text}, '{_WORD}'), lambda w: "
        r"regexp_replace(w, '[.''\-/#]+$', '')), lambda w: w <> '')"
    )


def norm(word: str) -> str:
    return f"regexp_replace(lower({word}), '(''s|’s|'')$', '')"


def norms(text: str = "text") -> str:
    return f"list_transform({words(text)}, lambda w: {norm('w')})"


def stem_norm(w: str) -> str:
    cases = [f"WHEN strlen({w}) <= 3 THEN {w}"]
    for suffix, keep, tail in (("ies", 3, "y"), ("sses", 4, ""), ("ing", 4, ""), ("ed", 4, ""), ("s", 3, "")):
        base = f"left({w}, length({w})-{len(suffix)})"
        cases.append(
            f"WHEN suffix({w}, '{suffix}') AND strlen({base}) >= {keep} AND NOT suffix({base}, 's') THEN {base}||'{tail}'"
        )
    return "(CASE " + " ".join(cases) + f" ELSE {w} END)"


def stems(text: str = "text") -> str:
    return f"list_transform({norms(text)}, lambda w: {stem_norm('w')})"


def terms(text: str = "text") -> str:
    return rf"list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: {stem_norm('w')})"


def content(text: str = "text") -> str:
    return rf"list_filter({norms(text)}, lambda w: regexp_matches(w, '\p{{L}}') AND w NOT IN {STOP})"


def tokens(text: str) -> str:
    """Distinct question tokens in order of first use."""
    kept = f"list_filter({norms(text)}, lambda w: length(w) >= 2 AND w NOT IN {STOP})"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def name_key(surface: str) -> str:
    toks = f"string_split(trim(regexp_replace(lower({surface}), '\\s+', ' ', 'g')), ' ')"
    bare = rf"list_transform({toks}, lambda w: regexp_replace(w, '''*(?:’s)*(?:''s)*$', ''))"
    return f"array_to_string(list_filter({bare}, lambda w: w <> ''), ' ')"


def grams(n: int, text: str = "query") -> str:
    """Keys of the runs of `n` words that are not all stopwords."""
    w = words(text)
    spans = f"list_transform(range(1, len({w})-{n}+2), lambda i: list_slice({w}, i, i+{n}-1))"
    useful = f"list_filter({spans}, lambda s: len(list_filter(s, lambda x: {norm('x')} NOT IN {STOP})) > 0)"
    return f"list_transform({useful}, lambda s: {name_key('array_to_string(s, chr(32))')})"


def mentions(turns: str = "turns", out: str = "mentions", text: str = "text", extra: str = "") -> str:
    """Name mentions of texts without digits or technical tokens, as CTEs ending in `out(turn_id, entity, kind)`."""
    not_name = quoted([*lx.MONTH_NUMBER, *lx.WEEKDAYS])
    link = quoted(lx.CONNECTORS)
    p = out + "_"
    return rf"""{p}items AS (SELECT id, UNNEST(items) AS item, UNNEST(range(1, len(items)+1)) AS pos FROM
 (SELECT id, regexp_extract_all({text}, '{_WORD}|[^\p{{L}}\p{{N}}''\-.$%#/+’]+') AS items FROM {turns})),
{p}placed AS (SELECT *, regexp_matches(item, '^{_WORD}$') AS is_word, regexp_replace(item, '[.''\-/#]+$', '') AS bare,
 coalesce(sum(length(item)) OVER w, 0) AS off,
 coalesce(sum(CASE WHEN regexp_matches(item, '[!?\n]') THEN 1 ELSE 0 END) OVER w, 0) AS bangs FROM {p}items
 WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}tok AS (SELECT id, bare AS w, off, bangs, substr(item, length(bare)+1) AS tail,
 row_number() OVER (PARTITION BY id ORDER BY pos) AS n,
 lag(bangs) OVER (PARTITION BY id ORDER BY pos) AS pbangs,
 lag(substr(item, length(bare)+1)) OVER (PARTITION BY id ORDER BY pos) AS ptail
 FROM {p}placed WHERE is_word AND bare <> ''),
{p}flag AS (SELECT *, (pbangs IS NULL OR pbangs <> bangs OR contains(ptail, '.')) AS opens,
 regexp_matches(w, '^\p{{Lu}}[\p{{L}}\p{{N}}''’\-.]*$') AS cap, regexp_matches(w, '^[A-Z][A-Z]+$') AS acro FROM {p}tok),
{p}bits AS (SELECT *,
 (CASE WHEN acro OR (cap AND regexp_replace(lower(w), '(?:’s)*(?:''s)*$', '') NOT IN {STOP} AND
   (NOT opens OR regexp_matches(substr(w, 2), '\p{{Lu}}') OR lower(w) NOT IN {not_name})) THEN 1 ELSE 0 END)
 + (CASE WHEN cap AND NOT opens AND lower(w) NOT IN {STOP} THEN 2 ELSE 0 END)
 + (CASE WHEN lower(w) IN {link} THEN 4 ELSE 0 END) + (CASE WHEN cap AND NOT opens THEN 8 ELSE 0 END) AS b FROM {p}flag),
{p}line AS (SELECT id, string_agg(chr(CAST(65+b AS INT)), '' ORDER BY n) AS s FROM {p}bits GROUP BY id),
{p}cut AS (SELECT id, UNNEST(r) AS run, UNNEST(range(1, len(r)+1)) AS k FROM
 (SELECT id, regexp_extract_all(s, '[BDFHJLNP](?:[CDGHKLOP]|[EFGHMNOP][I-P])*|.') AS r FROM {p}line)),
{p}runs AS (SELECT id, run, coalesce(sum(length(run)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING), 0) + 1 AS n FROM {p}cut),
{p}spans AS (SELECT r.id, a.off AS start_at, z.off + length(z.w) AS end_at FROM {p}runs r
 JOIN {p}bits a ON a.id = r.id AND a.n = r.n JOIN {p}bits z ON z.id = r.id AND z.n = r.n + length(r.run) - 1
 WHERE substr(r.run, 1, 1) IN ('B','D','F','H','J','L','N','P')),
{out} AS (SELECT t.id AS turn_id, {name_key('substr(t.' + text + ', CAST(s.start_at AS BIGINT)+1, CAST(s.end_at - s.start_at AS BIGINT))')} AS entity,
 'name' AS kind{extra} FROM {p}spans s JOIN {turns} t ON t.id = s.id)"""
