"""DuckDB statements that say what the catalogue's queries compute, written independently of them."""

from __future__ import annotations

from quire import lexicons as L
from quire.operators.label import CORPUS_TABLE, ESSENTIAL_PAST, TRANSLATOR
from quire.sources.bibliography import NUMBER, VOLUME


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _bw(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda v: v <> '')"


def _count(x: str, chars: str) -> str:
    return f"length(regexp_replace(coalesce({x}, ''), '[^{chars}]', '', 'g'))"


def _caps(x: str) -> str:
    n = _count(x, r"\p{L}")
    return rf"(CASE WHEN {n} > 0 THEN {_count(x, chr(92) + 'p{Lu}')} / {n} ELSE 0.0 END)"


def _az(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z]+')"


_LEX = "lex AS (SELECT lower(variant) v, min(canonical) c FROM lexicon_entities GROUP BY 1)"
_G = "g AS (SELECT canonical c, list_distinct(list(lower(variant))) forms, '(?i)\\b(' || string_agg(variant, '|' ORDER BY length(variant) DESC, variant) || ')\\b' pat FROM (SELECT DISTINCT * FROM lexicon_entities) GROUP BY 1)"
_M = f"""{_LEX}, m AS (SELECT mention_id, doc_id, file_name, sent_idx, sentence_text, context_text, ethnos_raw, doc_sent_count, doc_position_percent, coalesce(ethnos, c) ethnos_norm
  FROM mentions LEFT JOIN lex ON ethnos IS NULL AND lower(ethnos_raw) = v)"""
_S = "s AS (SELECT doc_id, sentence_index sent_idx, min(text) sentence_text FROM sentences GROUP BY 1, 2)"
_X = f"{_S}, {_G}, x AS (SELECT doc_id, sent_idx, sentence_text, c entity, unnest(regexp_extract_all(sentence_text, pat, 1)) surface FROM s, g)"

# --- text ---
_fold = "translate(raw_text, '‘’“”‐‑‒–—', '''''\"\"-----')"
_clean = rf"regexp_replace({_fold}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
for _w, _r in L.REPLACEMENTS:
    _clean = rf"regexp_replace(regexp_replace({_clean}, '\b{_w[0].upper()}(?i:{_w[1:]})\b', '{_r[0].upper() + _r[1:]}', 'g'), '\b{_w[0]}(?i:{_w[1:]})\b', '{_r}', 'g')"
_clean = rf"regexp_replace({_clean}, '[ \t]+', ' ', 'g')"
_clean = rf"regexp_replace(regexp_replace(regexp_replace({_clean}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
CLEAN_TEXT = f"WITH a AS (SELECT id, {_clean} c FROM corpus_documents) SELECT id, md5(c) cleaned, length(c) n FROM a"
SENTENCE_SPLIT = r"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'),
  '(?m)([.!?])\s*$', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(v, e' \t\n\r')), lambda v: v <> '') p FROM documents)
SELECT doc_id, unnest(range(len(p)))::INT sent_idx, md5(unnest(p)) h FROM a"""
_frame = lambda a, b: f"md5(coalesce(string_agg(sentence_text, ' ') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN {a} AND {b}), ''))"
CONTEXT_WINDOW = f"""WITH {_S} SELECT doc_id, sent_idx, {_frame('4 PRECEDING', '4 FOLLOWING')} around, {_frame('2 PRECEDING', '1 PRECEDING')} prev, {_frame('1 FOLLOWING', '2 FOLLOWING')} "next" FROM s"""
TOKENS_AZ = f"WITH {_S}, w AS (SELECT unnest({_az('sentence_text')}) word FROM s) SELECT word, count(*) n FROM w GROUP BY 1"
TOKENS_DOTTED = f"WITH {_M}, w AS (SELECT unnest({_bw(chr(39).join(['translate(lower(context_text), ', '.,', ', ', '  ', ')']))}) word FROM m) SELECT word, count(*) n FROM w GROUP BY 1"
_BARE = r"regexp_replace(regexp_replace(lower(coalesce(sentence_text, '')), '[0-9]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g')"
_norm = rf"""array_to_string(list_slice(list_filter({_bw(_BARE)}, lambda y: regexp_matches(y, '^\p{{L}}+$') AND NOT list_contains({_list(L.STOP_NOISE)}, y)), 1, 15), ' ')"""
SENTENCE_NORM = f"WITH {_M} SELECT mention_id, {_norm} norm FROM m"


def _garbage(w: str) -> str:
    triple = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
    return f"(length({w}) < 3 OR regexp_matches({w}, '{triple}') OR regexp_matches({w}, '[^aeiouy]{{4}}'))"


GARBAGE = f"WITH {_M}, w AS (SELECT unnest({_az('context_text')}) word FROM m) SELECT word, count(*) n FROM w WHERE {_garbage('word')} GROUP BY 1"
KWIC = rf"""WITH {_S}, w AS (SELECT doc_id, sent_idx, sentence_text, unnest(list_distinct(list_filter(string_split_regex(lower(sentence_text), '\s+'), lambda v: length(v) >= 3))) word FROM s WHERE length(sentence_text) >= 10),
t AS (SELECT word, count(*) n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 10),
r AS (SELECT w.*, n, row_number() OVER (PARTITION BY word ORDER BY doc_id, sent_idx) "rank", instr(lower(sentence_text), word) p FROM w JOIN t USING (word))
SELECT word, n, doc_id, sent_idx, "rank", substr(sentence_text, greatest(p - 50, 1), least(p - 1, 50)) "left", substr(sentence_text, p, length(word)) "match", substr(sentence_text, p + length(word), 50) "right" FROM r WHERE "rank" <= 3"""

# --- mentions ---
MENTION_EXTRACT = f"WITH {_X} SELECT doc_id, sent_idx, entity, surface, count(*) n FROM x GROUP BY ALL"
MENTIONS_TABLE = f"""WITH {_X}, c AS (SELECT doc_id, sent_idx, string_agg(sentence_text, ' ') OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) ctx, count(*) OVER (PARTITION BY doc_id) k FROM s)
SELECT doc_id, sent_idx, entity ethnos_norm, surface ethnos_raw, k doc_sent_count, count(*) n, md5(max(ctx)) context FROM x JOIN c USING (doc_id, sent_idx) GROUP BY ALL"""
LEMMA_MENTIONS = f"WITH {_S}, w AS (SELECT unnest({_az('sentence_text')}) l FROM s) SELECT l ethnos_norm, count(*) n FROM w WHERE l IN (SELECT lower(canonical) FROM lexicon_entities) GROUP BY 1"
RANGE_MENTIONS = rf"""WITH {_G}, q AS (SELECT id doc_id, c entity, raw_text t, pat, unnest(range(1, 1 + len(regexp_extract_all(raw_text, pat, 1)))) k, regexp_extract_all(raw_text, pat, 1) v, string_split_regex(raw_text, pat) w FROM corpus_documents, g WHERE raw_text IS NOT NULL),
h AS (SELECT doc_id, entity, v[k] surface, list_sum(list_transform(w[:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(v[:k - 1], lambda x: length(x))), 0)::BIGINT "start" FROM q),
p AS (SELECT DISTINCT doc_id, sentence_index, start_char, end_char FROM sentences WHERE start_char IS NOT NULL)
SELECT h.doc_id, entity, surface, "start", sentence_index FROM h JOIN p ON h.doc_id = p.doc_id AND "start" >= start_char AND "start" < end_char"""
DOC_SELECTOR = "SELECT id, filename FROM corpus_documents WHERE contains(lower(filename), 'journey_among') OR contains(lower(filename), 'copy_of_') OR contains(lower(filename), '1890')"
DOC_SENTENCES = "SELECT s.doc_id, filename, s.id, sentence_index FROM sentences s JOIN corpus_documents d ON d.id = s.doc_id"
FIRST_ENTITY = f"WITH {_X} SELECT doc_id, sent_idx, min(entity) entity FROM x GROUP BY 1, 2"
EVIDENCE_ROWS = f"""WITH {_X}, c AS (SELECT doc_id, sent_idx, {_frame('2 PRECEDING', '1 PRECEDING')} p, {_frame('1 FOLLOWING', '2 FOLLOWING')} f FROM s)
SELECT doc_id, sent_idx, entity, (sent_idx // 50)::INT doc_position_bucket, doc_id || '#sent=' || sent_idx pointer, count(*) n, max(p) prev, max(f) "next" FROM x JOIN c USING (doc_id, sent_idx) GROUP BY ALL"""
OFFSETS = """WITH a AS (SELECT doc_id, sentence_index, min(text) t, min(start_char) b, min(end_char) e FROM sentences GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) o FROM a)
SELECT doc_id, sentence_index, coalesce(b, o)::BIGINT start_char, coalesce(e, coalesce(b, o) + length(t))::BIGINT end_char FROM r"""

# --- noise ---
_p = "coalesce(doc_position_percent, 50.0)"
_bucket = f"CASE WHEN {_p} < 0 OR {_p} >= 100.01 THEN 'bucket_middle' WHEN {_p} < 5 THEN 'bucket_start' WHEN {_p} < 20 THEN 'bucket_early' WHEN {_p} < 80 THEN 'bucket_middle' WHEN {_p} < 95 THEN 'bucket_late' ELSE 'bucket_end' END"
_pct = f"round_even({_p} / 2, 0) * 2"
POSITION = f"WITH {_M} SELECT mention_id, {_bucket} bucket, {_pct} pct FROM m"
_T = "coalesce(sentence_text, '')"
_index_re = r"(?i)^(?:[A-Z][A-Z\s]+\s+[0-9]+)\s*$|^[\s\.,0-9\-]+$|(?:,\s*[0-9]+\s*){3,}|^[0-9]+(?:\s*[\-–]\s*[0-9]+)?\s*$"
_ws = _bw(f"trim({_T})")
_index = rf"""(trim({_T}) <> '' AND (regexp_matches(trim({_T}), '{_index_re}') OR (len({_ws}) >= 2 AND regexp_matches({_ws}[-1], '^[0-9]+$') AND len(list_filter({_ws}[:-2], lambda y: regexp_matches(y, '^\p{{L}}+$'))) > 0 AND {_caps(f"trim({_T})")} > 0.6)))"""
_stem = rf"regexp_replace(lower(coalesce(file_name, '')), '\.[^.]*$', '')"
_title_words = f"list_distinct({_bw(f'''translate({_stem}, '_-', '  ')''')})"
_marker = r"(?i)^(?:(?:page\s*)?[0-9]+\s*$|p\.\s*[0-9]+\s*$|pp\.\s*[0-9]+\s*$|[ivxlcdm]+\s*$|chapter\s+[ivxlcdm0-9]+\s*$)"
_letters = _count(f"trim({_T})", r"\p{L}")
_RAW = rf"""{_M}, b AS (SELECT *, {_norm} sentence_norm, {_pct} position_bucket_pct, count(*) OVER (PARTITION BY sentence_text) rep, {_bw(f"lower({_T})")} lw FROM m),
d AS (SELECT doc_id, sentence_norm, position_bucket_pct, count(*) k FROM b WHERE sentence_norm <> '' GROUP BY ALL),
e AS (SELECT sentence_norm, position_bucket_pct, count(*) docs FROM d GROUP BY ALL),
f AS (SELECT b.*, coalesce(k >= 2, false) is_position_header_footer, coalesce(docs >= 3, false) is_cross_doc_header_footer, coalesce(k >= 5, false) is_global_repeat,
  (rep >= 10 OR len(lw) < 5 OR {_caps(_T)} > 0.8 OR trim({_T}) = '' OR 10 * {_letters} < 3 * length(trim({_T})) OR regexp_matches(trim({_T}), '{_marker}')
   OR (list_has_any(lw, {_list(L.HEADER_WORDS)}) AND len(lw) < 8)
   OR ({_T} <> '' AND len({_title_words}) > 0 AND len(list_intersect({_title_words}, list_distinct(lw))) >= least(3, len({_title_words})))
   OR (({_p} <= 2 OR {_p} >= 98) AND rep >= 2) OR {_index}) is_probable_header_footer
  FROM b LEFT JOIN d ON b.doc_id IS NOT DISTINCT FROM d.doc_id AND b.sentence_norm = d.sentence_norm AND b.position_bucket_pct = d.position_bucket_pct
  LEFT JOIN e ON b.sentence_norm = e.sentence_norm AND b.position_bucket_pct = e.position_bucket_pct),
raw AS (SELECT *, is_position_header_footer OR is_cross_doc_header_footer OR is_global_repeat OR is_probable_header_footer is_noise,
  concat_ws('; ', CASE WHEN is_position_header_footer THEN 'position_header_footer' END, CASE WHEN is_cross_doc_header_footer THEN 'cross_doc_header_footer' END,
   CASE WHEN is_global_repeat THEN 'global_repeat' END, CASE WHEN is_probable_header_footer THEN 'probable_header_footer' END) noise_reason FROM f)"""
FLAGS = f"WITH {_RAW} SELECT mention_id, is_position_header_footer, is_cross_doc_header_footer, is_global_repeat, is_probable_header_footer, is_noise, noise_reason FROM raw"
REPEAT = f"WITH {_RAW} SELECT mention_id, sentence_norm, position_bucket_pct FROM raw WHERE is_position_header_footer"
CROSS = f"WITH {_RAW} SELECT mention_id, sentence_norm FROM raw WHERE is_cross_doc_header_footer"
HEADER = f"WITH {_RAW} SELECT mention_id FROM raw WHERE is_probable_header_footer"
SUMMARY = f"WITH {_RAW} SELECT doc_id, sentence_norm, position_bucket_pct, count(*) n, bool_or(is_position_header_footer) is_position_header_footer, bool_or(is_cross_doc_header_footer) is_cross_doc_header_footer, bool_or(is_global_repeat) is_global_repeat FROM raw GROUP BY ALL"
TOP_REPEATS = f"WITH {_RAW} SELECT sentence_norm, count(*) n FROM raw GROUP BY 1 ORDER BY n DESC, sentence_norm LIMIT 200"
_ev_re = r"(?i)\b(chapter|index|vol\.|volume|part|book|section|contents|page|pp\.)\b"
_EV = rf"""{_S}, a AS (SELECT doc_id, sent_idx, sentence_text, trim(lower({_T})) sentence_text_norm, (sent_idx // 50)::INT doc_position_bucket FROM s),
k AS (SELECT doc_id, sentence_text_norm, count(DISTINCT doc_position_bucket) k FROM a GROUP BY 1, 2),
ev AS (SELECT a.*, k >= 3 rp, (sentence_text_norm = '' OR len({_bw(_T)}) < 5 OR {_caps('sentence_text')} > 0.7 OR {_count('sentence_text', '0-9')} / greatest(length({_T}), 1) > 0.4
  OR regexp_matches(sentence_text_norm, '{_ev_re}') OR regexp_matches(sentence_text, '{_ev_re}')) ix FROM a JOIN k USING (doc_id, sentence_text_norm))"""
EVIDENCE_NOISE = f"WITH {_EV} SELECT doc_id, sent_idx, doc_position_bucket, rp OR ix is_noise, concat_ws('; ', CASE WHEN rp THEN 'positional_repeat' END, CASE WHEN ix THEN 'index_like' END) noise_reason FROM ev"
EVIDENCE_REPEATS = f"""WITH {_EV}, t AS (SELECT sentence_text_norm, count(*) n, array_to_string(list_sort(list_distinct(list(doc_id::VARCHAR))), '|') docs FROM ev GROUP BY 1)
SELECT left(sentence_text_norm, 500) sentence_text_norm, n, left(docs, 2000) docs FROM t ORDER BY n DESC, t.sentence_text_norm LIMIT 500"""
_n1 = f"greatest(length(trim({_T})), 1)"
PREDICATES = rf"""WITH {_S} SELECT doc_id, sent_idx,
 (length(trim({_T})) < 20 OR len({_ws}) < 5 OR {_count(f"trim({_T})", '0-9')} / {_n1} > 0.3 OR {_count(f"trim({_T})", '.,;:!?')} / {_n1} > 0.25
  OR regexp_matches({_T}, '(?i)\b(contents?|index|chapter|page\s*[0-9]+|part\s+[ivxlcdm]+)\b') OR regexp_matches(trim({_T}), ',\s*[0-9]+\s*$')) translator,
 (length(trim({_T})) >= 25 AND NOT regexp_matches(trim({_T}), '(?i)^\s*(Chapter|Page|Part|Book\s+[IVXLCDM0-9]+|[0-9]+\s*\.\s*[A-Z]|[IVXLCDM]+\s*\.)\s') AND {_count(f"trim({_T})", '0-9')} <= length(trim({_T})) // 2) content,
 (trim({_T}) <> '' AND NOT regexp_matches(trim({_T}), '(?i)^(?:[A-Z][A-Z\s]+\s+[0-9]+)\s*$|^[\s\.,0-9\-]+$|(?:,\s*[0-9]+\s*){{3,}}') AND 2 * {_letters} >= length(trim({_T})) AND len({_ws}) >= 5) interaction,
 {_index} index_like FROM s"""

# --- labels ---
_words = f"list_distinct(list_concat(list_distinct({_az('context_text')}), epi))"
_near = rf"""list_distinct(list_filter(list_slice(sw, greatest(pos - 5, 1), pos + 5), lambda y: lower(y) <> lower(ethnos_raw) AND NOT list_contains({_list([*L.EPITHET_STOP, 'the', 'a', 'an'])}, lower(y)) AND NOT regexp_matches(y, '^[0-9]+$') AND length(y) > 1))"""
_EPI = f"""{{src}}, ea AS (SELECT *, {_bw(_T)} sw FROM {{name}}), eb AS (SELECT *, coalesce(list_position(list_transform(sw, lambda y: lower(y)), lower(ethnos_raw)), 0) pos FROM ea),
ep AS (SELECT *, CASE WHEN pos > 0 THEN {_near} ELSE [] END epithets FROM eb)"""


def _label(src: str, name: str) -> str:
    out = _EPI.format(src=src, name=name) + ", la AS (SELECT *, list_transform(epithets, lambda y: lower(y)) epi FROM ep), lb AS (SELECT *, " + _words + " rw FROM la)"
    for k, v in L.REPRESENTATION.items():
        hit = f"list_intersect(rw, {_list(sorted(set(v)))})"
        prev = "lb" if k == "negative" else "l" + {"exotic": "negative", "positive": "exotic"}[k]
        out += f", l{k} AS (SELECT *, (10 * len({hit}) + 2 * len(list_intersect({hit}, epi)))::INT score_{k} FROM {prev})"
    out += ", lr AS (SELECT *, list_sort([score_negative, score_exotic, score_positive], 'DESC') rs FROM lpositive)"
    out += """, ls AS (SELECT *, CASE WHEN rs[1] <= 0 THEN 'neutral' WHEN rs[1] - rs[2] < 10 THEN 'uncertain' WHEN score_exotic = rs[1] THEN 'exotic' WHEN score_negative = rs[1] THEN 'negative' ELSE 'positive' END r_label,
 CASE WHEN rs[1] <= 0 THEN 0.3 WHEN rs[1] - rs[2] < 10 THEN 0.4 ELSE least(0.9, round_even(0.5::DOUBLE + 0.15::DOUBLE * least(rs[1] / 10.0::DOUBLE, 3.0::DOUBLE), 2)) END::DOUBLE r_confidence FROM lr)"""
    doms = ", ".join("{'s': -len(list_filter(" + _list(v) + f", lambda y: list_contains(ow, y))), 'k': {_q(k)}}}" for k, v in sorted(L.SITUATION.items()))
    dotted = _bw("translate(lower(coalesce(context_text, '')), '.,', '  ')")
    out += f", lo AS (SELECT *, {dotted} ow FROM ls), lp AS (SELECT *, list_sort([{doms}]) os FROM lo)"
    out += """, lq AS (SELECT *, CASE WHEN os[1].s = 0 THEN 'unknown' WHEN os[2].s < 0 AND 10 * os[2].s <= 6 * os[1].s THEN 'mixed' ELSE os[1].k END o_label,
 CASE WHEN os[1].s = 0 THEN 0.2 WHEN os[2].s < 0 AND 10 * os[2].s <= 6 * os[1].s THEN 0.4 ELSE least(0.9, round_even(0.5::DOUBLE + 0.1::DOUBLE * least(-os[1].s, 4), 2)) END::DOUBLE o_confidence FROM lp)"""
    out += f", {_G}, e0 AS (SELECT lq.*, coalesce(forms, [lower(ethnos_norm)]) forms, '' pat0, '' sp0 FROM lq LEFT JOIN g ON g.c = ethnos_norm)"
    for i, (n, p) in enumerate(ESSENTIAL_PAST):
        span = f"trim(regexp_extract({_T}, '(?i){p}', 0))"
        ok = f"({span} <> '' AND list_contains(forms, lower(regexp_extract({_T}, '(?i){p}', 1))) AND length({span}) > length(sp{i}))"
        out += f", e{i + 1} AS (SELECT *, CASE WHEN {ok} THEN '{n}' ELSE pat{i} END pat{i + 1}, CASE WHEN {ok} THEN left({span}, 120) ELSE sp{i} END sp{i + 1} FROM e{i})"
    k = len(ESSENTIAL_PAST)
    out += f", lab AS (SELECT *, pat{k} <> '' is_essentializing, pat{k} essentialization_pattern, sp{k} essentialization_span FROM e{k}), cl AS (SELECT * FROM lab WHERE NOT is_noise)"
    return out


_LAB = _label(_RAW, "raw")
R_CLASSIFY = f"WITH {_LAB} SELECT mention_id, score_negative, score_exotic, score_positive, r_label, r_confidence FROM lab"
_any = lambda k: f"list_has_any({_az('context_text')}, {_list(L.REPRESENTATION[k])})"
R_PRIORITY = f"WITH {_M} SELECT mention_id, CASE WHEN {_any('negative')} THEN 'negative' WHEN {_any('exotic')} THEN 'exotic' WHEN {_any('positive')} THEN 'positive' ELSE 'neutral' END r FROM m"
O_CLASSIFY = f"WITH {_LAB} SELECT mention_id, o_label, o_confidence FROM lab"
_EPM = _EPI.format(src=_M, name="m")
EPITHETS = f"WITH {_EPM} SELECT mention_id, unnest(epithets) epithet FROM ep"
ESSENTIAL = f"WITH {_LAB} SELECT mention_id, essentialization_pattern, essentialization_span FROM lab WHERE is_essentializing"
_ESS = "es AS (SELECT ethnos_norm, count(*) n FROM (SELECT DISTINCT ethnos_norm, doc_id, sent_idx FROM lab WHERE is_essentializing) GROUP BY 1)"
ESSENTIAL_TABLE = f"WITH {_LAB}, {_ESS} SELECT * FROM es"
ESSENTIAL_EXAMPLES = rf"WITH {_LAB} SELECT ethnos_norm, trim(regexp_replace(lower(sentence_text), '\s+', ' ', 'g')) norm, min(mention_id) mention_id FROM lab WHERE is_essentializing GROUP BY 1, 2"
_first = "CASE " + " ".join(f"WHEN regexp_matches(sentence_text, '(?i){p}') THEN '{n}'" for n, p in ESSENTIAL_PAST) + " END"
_tr = "CASE " + " ".join(f"WHEN regexp_matches(sentence_text, '(?i){p}') THEN '{n}'" for n, p in TRANSLATOR) + " END"
PATTERN_STATS_TRANSLATOR = f"WITH {_M}, p AS (SELECT ethnos_norm, {_tr} pattern FROM m) SELECT ethnos_norm, pattern, count(*) n FROM p WHERE pattern IS NOT NULL GROUP BY 1, 2"
ESSENTIAL_CORPUS = f"WITH {_X} SELECT entity ethnos_norm, count(*) n FROM (SELECT DISTINCT doc_id, sent_idx, entity FROM x WHERE regexp_matches(sentence_text, replace('{CORPUS_TABLE}', '{{X}}', surface))) GROUP BY 1"
PATTERN_STATS = f"WITH {_M}, p AS (SELECT ethnos_norm, {_first} pattern FROM m) SELECT ethnos_norm, pattern, count(*) n FROM p WHERE pattern IS NOT NULL GROUP BY 1, 2"


def _markers(words) -> str:
    return f"WITH {_M}, w AS (SELECT ethnos_norm entity, unnest(list_intersect(list_distinct({_az('context_text')}), {_list(words)})) marker FROM m) SELECT entity, marker, count(*) n FROM w GROUP BY 1, 2"


MARKERS, LANDSCAPE = _markers(L.REPRESENTATION["exotic"]), _markers(L.LANDSCAPE)
PITFALLS = f"WITH {_M} SELECT mention_id, unnest(list_slice(list_filter({_list(sorted(L.REPRESENTATION['negative']))}, lambda y: contains(lower(context_text), y)), 1, 3)) pitfall FROM m"
CONFIDENCE = f"WITH {_LAB} SELECT mention_id, least((CASE WHEN r_confidence >= 0.6 THEN 20 ELSE 0 END + CASE WHEN o_confidence >= 0.6 THEN 20 ELSE 0 END + CASE WHEN is_essentializing THEN 15 ELSE 0 END), 100) / 100.0::DOUBLE confidence FROM lab"
PIRO = f"WITH {_LAB} SELECT mention_id, ethnos_norm, r_label, o_label, is_essentializing, len(epithets)::INT n_epithets, coalesce(file_name, '') || '#' || sent_idx pointer FROM lab"

# --- aggregates ---
COUNTS_BY_DOC = f'WITH {_M} SELECT doc_id, ethnos_norm "group", count(*) n, max(doc_sent_count) sentences, 10000.0::DOUBLE * count(*) / greatest(coalesce(max(doc_sent_count), 0), 1) rate FROM m GROUP BY 1, 2'


def rates(column: str) -> str:
    return f"""WITH {_LAB}, dr AS (SELECT doc_id, {column} gr, count(*) n, 10000.0::DOUBLE * count(*) / greatest(coalesce(max(doc_sent_count), 0), 1) rate FROM cl GROUP BY 1, 2)
SELECT gr "group", sum(n)::BIGINT n, count(*) documents, round(avg(rate), 6) mean_rate, round(quantile_cont(rate, 0.5), 6) median_rate FROM dr GROUP BY 1"""


_stop = f"length(w) >= 2 AND NOT list_contains({_list(L.STOP_KEYNESS)}, w)"
_tri = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_score = f"""sc AS (SELECT *, nf * (ff + fr) / (nf + nr)::DOUBLE x1, nr * (ff + fr) / (nf + nr)::DOUBLE x2 FROM j WHERE ff >= 2 AND NOT {_garbage('w')}),
sk AS (SELECT comparison, w word, ff freq_focus, fr freq_ref, round(CASE WHEN nf <= 0 OR nr <= 0 OR x1 <= 0 OR x2 <= 0 THEN 0.0 ELSE greatest(0.0, 2.0 * ((CASE WHEN ff > 0 THEN ff * ln(ff / x1) ELSE 0.0 END) + (CASE WHEN fr > 0 THEN fr * ln(fr / x2) ELSE 0.0 END))) END, 6)::DOUBLE g2,
  round(log2(((ff + 0.5::DOUBLE) / (nf + 1.0::DOUBLE)) / ((fr + 0.5::DOUBLE) / (nr + 1.0::DOUBLE))), 6) log_ratio FROM sc)"""
KEYNESS_R = f"""WITH {_LAB}, t AS (SELECT r_label side, unnest({_az('context_text')}) w FROM cl), k AS (SELECT side, w, count(*) n FROM t WHERE {_stop} GROUP BY 1, 2),
j AS (SELECT k.side comparison, k.w, k.n ff, coalesce(r.n, 0) fr, (SELECT sum(n) FROM k z WHERE z.side = k.side)::BIGINT nf, (SELECT coalesce(sum(n), 0) FROM k z WHERE z.side = 'neutral')::BIGINT nr
  FROM k LEFT JOIN k r ON r.w = k.w AND r.side = 'neutral' WHERE k.side <> 'neutral'), {_score} SELECT * FROM sk"""
_KE = f"""{_LAB}, t AS (SELECT ethnos_norm side, unnest({_az('context_text')}) w FROM cl), k AS (SELECT side, w, count(*) n FROM t WHERE {_stop} GROUP BY 1, 2),
kw AS (SELECT w, sum(n)::BIGINT a FROM k GROUP BY 1), ks AS (SELECT side, sum(n)::BIGINT b FROM k GROUP BY 1), kt AS (SELECT sum(n)::BIGINT c FROM k),
j AS (SELECT k.side comparison, k.w, n ff, a - n fr, b nf, c - b nr FROM k JOIN kw USING (w) JOIN ks USING (side), kt), {_score}"""
KEYNESS_ENTITY = f"WITH {_KE} SELECT * FROM sk"
KEYNESS_TOP = f'WITH {_KE}, r AS (SELECT comparison, word, g2, row_number() OVER (PARTITION BY comparison ORDER BY g2 DESC, word)::INT "rank" FROM sk) SELECT * FROM r WHERE "rank" <= 20'
OI = f"WITH {_LAB} SELECT ethnos_norm, avg((r_label IN ('negative', 'exotic'))::INT) oi, count(*) mentions FROM cl GROUP BY 1"
EPS = f"WITH {_LAB} SELECT ethnos_norm, avg(CASE r_label WHEN 'negative' THEN 1 WHEN 'positive' THEN -1 ELSE 0 END) eps FROM cl GROUP BY 1"
_ED = "ed AS (SELECT coalesce(a.ethnos_norm, b.ethnos_norm) ethnos_norm, CASE WHEN coalesce(b.n, 0) > 0 THEN coalesce(a.n, 0) / b.n ELSE 0.0 END::DOUBLE ed FROM es a FULL JOIN (SELECT ethnos_norm, count(*) n FROM lab GROUP BY 1) b ON a.ethnos_norm = b.ethnos_norm)"
ED = f"WITH {_LAB}, {_ESS}, {_ED} SELECT * FROM ed"
_first_at = "length(regexp_extract(lower(sentence_text), '^(.*?)\\b(' || lower(f) || ')\\b', 1)) + 1"
_kinds = ", ".join(f"CASE WHEN list_has_any({_az('sentence_text')}, {_list(v)}) THEN '{k}' END" for k, v in sorted(L.VERBS.items()))
_fit = rf"trim({_T}) <> '' AND NOT regexp_matches(trim({_T}), '(?i)^(?:[A-Z][A-Z\s]+\s+[0-9]+)\s*$|^[\s\.,0-9\-]+$|(?:,\s*[0-9]+\s*){{3,}}') AND 2 * {_letters} >= length(trim({_T})) AND len({_ws}) >= 5"
_HITS = rf"""fs AS (SELECT * FROM s WHERE {_fit}), hp AS (SELECT doc_id, sent_idx, sentence_text, c entity, length(regexp_extract(lower(sentence_text), '(?s)^(.*?)' || replace(pat, '(?i)', ''), 1)) p FROM fs, g WHERE regexp_matches(lower(sentence_text), pat)),
hr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY p, entity) r FROM hp),
hh AS (SELECT a.doc_id, a.sent_idx, a.sentence_text, a.entity src, b.entity dst FROM hr a JOIN hr b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.r = 1 AND b.r = 2),
hits AS (SELECT * FROM (SELECT doc_id, sent_idx, sentence_text, src, dst, unnest([{_kinds}]) type FROM hh) WHERE type IS NOT NULL AND src <> dst),
ed0 AS (SELECT src, dst, type, count(*) n FROM hits GROUP BY ALL)"""
_SG = f"{_S}, {_G.replace(' pat FROM', ' pat FROM')}"
_ASQ = "ag AS (SELECT entity, sum(s) / sum(t) agency FROM (SELECT src entity, n s, n t FROM ed0 UNION ALL SELECT dst, -n, n FROM ed0) GROUP BY 1)"
AS = f"WITH {_SG}, {_HITS}, {_ASQ} SELECT * FROM ag"
_PR = f"""{_LAB}, {_ESS}, {_ED}, {_S}, {_HITS}, {_ASQ}, ns AS (SELECT count(*) k FROM s),
pa AS (SELECT ethnos_norm, count(*) mentions, avg((r_label IN ('negative', 'exotic'))::INT) oi, avg(CASE r_label WHEN 'negative' THEN 1 WHEN 'positive' THEN -1 ELSE 0 END) eps,
  avg((r_label = 'uncertain')::INT) uncertain_r, avg((o_label = 'unknown')::INT) unknown_o, avg(is_noise::INT) noise_share FROM lab GROUP BY 1),
pb AS (SELECT pa.*, coalesce(ed, 0.0) ed, coalesce(agency, 0.0) agency, mentions * 10000.0::DOUBLE / greatest(k, 1) mentions_norm FROM pa LEFT JOIN ed USING (ethnos_norm) LEFT JOIN ag ON entity = ethnos_norm, ns)"""
_r9 = ", ".join(f"round({c}, 9) {c}" for c in ("mentions_norm", "oi", "eps", "ed", "agency", "uncertain_r", "unknown_o", "noise_share"))
PROFILES = f"WITH {_PR} SELECT ethnos_norm, mentions, {_r9} FROM pb"
DELTAS = f"WITH {_PR} SELECT ethnos_norm, " + ", ".join(f"round({c} - (SELECT sum({c} * mentions) / sum(mentions) FROM pb), 6) {c}_delta" for c in ("oi", "eps", "ed", "agency")) + " FROM pb"
RANKING = f"WITH {_LAB}, a AS (SELECT ethnos_norm, avg((r_label IN ('negative', 'exotic'))::INT) oi FROM cl GROUP BY 1) SELECT * FROM a ORDER BY coalesce(oi, 0) DESC, ethnos_norm LIMIT 15"

RANKING_ED = f"WITH {_PR} SELECT ethnos_norm, round(ed, 9) ed FROM pb ORDER BY coalesce(round(ed, 9), 0) DESC, ethnos_norm LIMIT 15"


def chi2(column: str) -> str:
    return f"""WITH {_LAB}, c AS (SELECT ethnos_norm a, {column} b, count(*) o FROM cl WHERE ethnos_norm IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(o) na FROM c GROUP BY 1), rb AS (SELECT b, sum(o) nb FROM c GROUP BY 1), t AS (SELECT sum(o) n FROM c),
fx AS (SELECT coalesce(o, 0) o, na * nb / n::DOUBLE e FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN c USING (a, b)),
z AS (SELECT sum((o - e) ^ 2 / e) x, sum((e < 5)::INT)::BIGINT low_expected FROM fx), k AS (SELECT (SELECT count(*) FROM ra) r, (SELECT count(*) FROM rb) q)
SELECT round(x, 6) chi2, (r - 1) * (q - 1) dof, round(sqrt(x / (n * (least(r, q) - 1))), 9) cramers_v, low_expected, n::BIGINT n FROM z, k, t"""


_cols = ["mentions", "oi", "eps", "ed", "agency"]
_corr = lambda src: " UNION ALL ".join(f"SELECT '{x}' x, '{y}' y, round(corr({x}, {y}), 6) r FROM {src}" for i, x in enumerate(_cols) for y in _cols[i + 1 :])
PEARSON = f"WITH {_PR} {_corr('pb')}"
_rank = ", ".join(f"rank() OVER (ORDER BY v_{c}) + (count(*) OVER (PARTITION BY v_{c}) - 1) / 2 {c}" for c in _cols)
SPEARMAN = f"WITH {_PR}, v AS (SELECT " + ", ".join(f"round({c}, 9) v_{c}" for c in _cols) + f" FROM pb), w AS (SELECT {_rank} FROM v) {_corr('w')}"
PURITY = """WITH e AS (SELECT (vec_id % 7 - 1)::INT cluster, label FROM embeddings), c AS (SELECT cluster, label, count(*) n FROM e GROUP BY 1, 2), t AS (SELECT cluster, max(n) m, sum(n) n FROM c GROUP BY 1)
SELECT sum(m) FILTER (cluster >= 0) / sum(n) FILTER (cluster >= 0) purity, coalesce(sum(n) FILTER (cluster < 0), 0) / sum(n) noise_ratio FROM t"""
SURFACE = f"""WITH {_M}, c AS (SELECT ethnos_norm, lower(ethnos_raw) form, count(*) n FROM m WHERE ethnos_norm IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY ethnos_norm)::BIGINT total FROM c),
r AS (SELECT *, round_even(100.0::DOUBLE * n / total, 1) pct, row_number() OVER (PARTITION BY ethnos_norm ORDER BY n DESC, form)::INT "rank" FROM t) SELECT ethnos_norm, form, n, total, pct, "rank" FROM r WHERE "rank" <= 15"""
_tab = lambda col, vals: f"WITH {_LAB} SELECT ethnos_norm, " + ", ".join(f"count(*) FILTER ({col} = '{v}') \"{v}\"" for v in vals) + " FROM cl GROUP BY 1"
HEATMAP_R = _tab("r_label", ["negative", "exotic", "positive", "neutral", "uncertain"])
HEATMAP_O = _tab("o_label", [*sorted(L.SITUATION), "mixed", "unknown"])
R_O = f"WITH {_LAB} SELECT r_label, o_label, count(*) n FROM cl GROUP BY 1, 2"
DISTRIBUTION = f"WITH {_LAB} " + " UNION ALL ".join(f"SELECT '{c}' dimension, {c} \"value\", count(*) n FROM lab GROUP BY 2" for c in ("ethnos_norm", "r_label", "o_label"))
TOP_EPITHETS = f"WITH {_EPM}, u AS (SELECT unnest(epithets) epithet FROM ep) SELECT epithet, count(*) n FROM u GROUP BY 1 ORDER BY n DESC, epithet LIMIT 30"


# --- networks ---
def _sets(*windows: int) -> str:
    each = " UNION ALL ".join(f"SELECT DISTINCT {w} w, a.doc_id, a.sent_idx, e.entity FROM nn a JOIN ee e ON a.doc_id = e.doc_id AND e.rn BETWEEN a.rn - {w} AND a.rn + {w}" for w in windows)
    return f"""{_X}, nn AS (SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) rn FROM s), ee AS (SELECT DISTINCT doc_id, rn, entity FROM x JOIN nn USING (doc_id, sent_idx)), st AS ({each}),
pr AS (SELECT a.w, a.entity a, b.entity b, count(*) n FROM st a JOIN st b ON a.w = b.w AND a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.entity < b.entity GROUP BY ALL), sg AS (SELECT w, entity, count(*) k FROM st GROUP BY ALL)"""


COMENTION = f"WITH {_sets(2)} SELECT a, b, n FROM pr"
JACCARD = f"WITH {_sets(2)} SELECT x.entity a, y.entity b, coalesce(n, 0) n, round(coalesce(n, 0) / (x.k + y.k - coalesce(n, 0)), 4) jaccard FROM sg x JOIN sg y ON x.entity < y.entity LEFT JOIN pr ON pr.a = x.entity AND pr.b = y.entity"
NPMI = f"WITH {_sets(2)}, tt AS (SELECT count(*) t FROM s) SELECT a, b, n, round(CASE WHEN n = t THEN 0.0 ELSE log2(n * t / (x.k * y.k)::DOUBLE) / -log2(n / t::DOUBLE) END, 9)::DOUBLE npmi FROM pr JOIN sg x ON x.entity = a JOIN sg y ON y.entity = b, tt"
SENSITIVITY = f"""WITH {_sets(1, 2, 3)}, r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, a, b) r FROM pr), t AS (SELECT * FROM r WHERE r <= 30), q AS (SELECT a, b FROM t WHERE w = 2)
SELECT t.w::INT w, (SELECT count(*) FROM pr p WHERE p.w = t.w) edges, count(q.a) overlap, count(q.a) / greatest(least(count(*), (SELECT count(*) FROM q)), 1) ratio FROM t LEFT JOIN q USING (a, b) GROUP BY t.w"""
EDGES = f"WITH {_SG}, {_HITS} SELECT src, dst, type, count(*) n, 0::BIGINT high, 0::BIGINT medium, count(*) low, 'low' confidence, least(count(DISTINCT left(sentence_text, 300)), 3)::INT n_examples FROM hits GROUP BY 1, 2, 3"
ROBUST = f"WITH {_SG}, {_HITS} SELECT src, dst, type, n FROM ed0 WHERE n >= 2"
CONF_TALLY = f"WITH {_SG}, {_HITS} SELECT 'low' confidence, count(*) n FROM ed0 HAVING count(*) > 0"
DEGREES = f"WITH {_SG}, {_HITS}, b AS (SELECT src node, n o, 0 i FROM ed0 UNION ALL SELECT dst, 0, n FROM ed0) SELECT node, sum(o)::BIGINT out_degree, sum(i)::BIGINT in_degree, sum(o + i)::BIGINT degree, sum(o - i)::BIGINT balance FROM b GROUP BY 1"
METRICS = f"""WITH {_SG}, {_HITS}, e AS (SELECT src, dst, sum(n) n FROM ed0 GROUP BY 1, 2), k AS (SELECT count(DISTINCT v) k FROM (SELECT src v FROM e UNION ALL SELECT dst FROM e)),
z AS (SELECT count(*) e, sum(n) t, sum((EXISTS (SELECT 1 FROM e y WHERE y.src = e.dst AND y.dst = e.src))::INT) r FROM e)
SELECT k nodes, e edges, e / (k * (k - 1)) density, r / e reciprocity, 2.0::DOUBLE * t / k mean_degree, 2.0::DOUBLE * t / (k * (k - 1)) weighted_density FROM z, k"""

# --- evidence ---
PACK = f"""WITH {_LAB}, c AS (SELECT r_label category, * FROM cl WHERE r_label IN ('negative', 'exotic', 'positive', 'neutral') UNION ALL SELECT 'essentializing', * FROM cl WHERE is_essentializing),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY r_confidence DESC, mention_id)::INT "rank" FROM c)
SELECT category, "rank", mention_id, md5(CASE WHEN length(context_text) > 400 THEN left(context_text, 400) || '...' ELSE context_text END) context FROM r WHERE "rank" <= 10"""
STRATIFIED = f"""WITH {_RAW}, c AS (SELECT mention_id, ethnos_norm FROM raw WHERE NOT is_noise AND ethnos_norm IS NOT NULL), z AS (SELECT ethnos_norm, count(*) n FROM c GROUP BY 1 ORDER BY n DESC, ethnos_norm LIMIT 30),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.ethnos_norm ORDER BY mention_id) r, z.n IS NOT NULL i FROM c LEFT JOIN z USING (ethnos_norm))
SELECT mention_id, ethnos_norm FROM r ORDER BY CASE WHEN i AND r <= 33 THEN 0 ELSE 1 END, mention_id LIMIT 1000"""
SAMPLE = f"WITH {_M} SELECT mention_id FROM m ORDER BY md5(mention_id::VARCHAR), mention_id LIMIT 500"
_themes = " UNION ALL ".join(f"SELECT '{n}' theme, {i} o, mention_id, row_number() OVER (ORDER BY mention_id) r FROM lab WHERE {c}" for i, (n, c) in enumerate([("essential", "is_essentializing"), ("negative", "r_label = 'negative'"), ("trade", "o_label = 'trade'"), ("exotic", "r_label = 'exotic'")]))
WORKSHOP = f"WITH {_LAB}, t AS ({_themes}) SELECT theme, mention_id, row_number() OVER (ORDER BY o, r)::INT case_id FROM t WHERE r <= 5"
CANDIDATES = rf"WITH {_M} SELECT mention_id FROM m WHERE length(trim({_T})) >= 25 AND NOT regexp_matches(trim({_T}), '(?i)^\s*(Chapter|Page|Part|Book\s+[IVXLCDM0-9]+|[0-9]+\s*\.\s*[A-Z]|[IVXLCDM]+\s*\.)\s') AND {_count(f'trim({_T})', '0-9')} <= length(trim({_T})) // 2 ORDER BY mention_id LIMIT 10"
SCATTER = f"WITH {_PR}, r AS (SELECT *, row_number() OVER (ORDER BY mentions DESC, ethnos_norm) k2 FROM pb) SELECT ethnos_norm, k2 <= 10 OR abs(agency) > 0.5 OR oi > 0.6 labelled, CASE WHEN mentions < 20 THEN 'low' ELSE 'ok' END reliability FROM r"
PASSPORT = f"WITH {_RAW} SELECT count(DISTINCT doc_id) documents, count(*) mentions, count(*) FILTER (NOT is_noise) clean, round_even(100.0::DOUBLE * count(*) FILTER (is_noise) / greatest(count(*), 1), 1) noise_pct FROM raw"
SHARES = f"WITH {_LAB} SELECT avg((r_label = 'uncertain')::INT) uncertain_r, avg((o_label IN ('unknown', 'mixed'))::INT) unclear_o FROM lab"

# --- sources ---
_parts = r"string_split(regexp_replace(filename, '\.[^.]*$', ''), '_')"
FILENAMES = rf"""WITH a AS (SELECT id, {_parts} p FROM corpus_documents WHERE filename IS NOT NULL), b AS (SELECT *, coalesce(list_position(list_transform(p, lambda v: regexp_matches(v, '^[0-9]{{4}}$')), true), 0) k FROM a)
SELECT id, CASE WHEN k > 0 THEN trim(array_to_string(list_slice(p, 1, k - 1), ' '), ' _-') ELSE '' END author, CASE WHEN k > 0 THEN p[k]::INT END "year",
 trim(array_to_string(CASE WHEN k > 0 THEN list_slice(p, k + 1, len(p)) ELSE p END, ' '), ' _-') title FROM b"""
_t = r"lower(concat_ws(' ', title, regexp_replace(coalesce(txt_filename, ''), '[_.]', ' ', 'g')))"
_num = lambda x: f"coalesce(map {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in NUMBER.items())}}}[{x}], {x})"
_sig = "CASE " + " ".join(f"WHEN regexp_extract({_t}, '{p}', 1) <> '' THEN '{k}' || " + _num(f"regexp_extract({_t}, '{p}', 1)") for k, p in VOLUME) + " ELSE '' END"
VOLUMES = f"SELECT DISTINCT identifier, harvested_at, {_sig} sig FROM bibliography"
_pl = lambda x: rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_sur = r"CASE WHEN contains(trim(coalesce(creator, '')), ',') THEN trim(string_split(trim(coalesce(creator, '')), ',')[1]) ELSE string_split_regex(trim(coalesce(creator, '')), '\s+')[-1] END"
_ts = lambda n: f"array_to_string(list_slice(string_split({_pl('title')}, ' '), 1, {n}), ' ')"
BIBLIO_KEYS = f"""SELECT DISTINCT identifier, {_pl(_sur)} surname, {_ts(4)} title4, nullif(try_cast(left(regexp_replace("year"::VARCHAR, '[^0-9]', '', 'g'), 4) AS INT), 0) y FROM bibliography"""
BIBLIO_DEDUP = f"""WITH a AS (SELECT *, trim(coalesce(volume_sig, '')) sg FROM bibliography),
r AS (SELECT identifier, harvested_at, row_number() OVER (PARTITION BY {_pl(_sur)}, CASE WHEN sg <> '' THEN {_ts(10)} ELSE {_ts(4)} END, "year", sg ORDER BY (coalesce(txt_url, '') = '')::INT, harvested_at NULLS FIRST, identifier NULLS FIRST, txt_filename NULLS FIRST) r FROM a)
SELECT identifier, harvested_at FROM r WHERE r = 1"""
BIBLIO_YEARS = 'WITH r AS (SELECT identifier, "year", harvested_at, row_number() OVER (PARTITION BY identifier ORDER BY harvested_at) r FROM bibliography WHERE "year" BETWEEN 1850 AND 1900) SELECT identifier, "year", harvested_at FROM r WHERE r = 1'
PUBLISHERS = "SELECT DISTINCT identifier, publisher FROM bibliography WHERE trim(coalesce(publisher, '')) = '' OR regexp_matches(lower(publisher), 'eastport|merrow')"
_flat = lambda x: rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_latest = lambda *f: "row_number() OVER (PARTITION BY identifier ORDER BY harvested_at DESC, " + ", ".join(f"coalesce({x}::VARCHAR, '') DESC" for x in f) + ") = 1"
FILE_MATCH = rf"""WITH b AS (SELECT identifier, creator, "year", title, txt_filename FROM bibliography QUALIFY {_latest('creator', '"year"', 'title', 'txt_filename')}), f AS (SELECT DISTINCT filename FROM corpus_documents WHERE filename IS NOT NULL),
n AS (SELECT identifier, filename file_name FROM b JOIN f ON txt_filename = filename AND txt_filename <> ''),
o AS (SELECT identifier, min(filename) file_name FROM b JOIN f ON coalesce(txt_filename, '') = '' AND "year"::VARCHAR = regexp_extract(filename, '_([0-9]{{4}})_', 1) AND {_flat(_sur)} = {_flat("regexp_extract(filename, '^([^_]*)_', 1)")}
  AND contains({_flat(r"regexp_replace(filename, '\.txt$', '')")}, left({_flat('title')}, 40)) GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o"""
_san = lambda x: rf"left(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '[^\p{{L}}\p{{N}} _-]', '', 'g'), '[\s-]+', '_', 'g'), '^_+|_+$', '', 'g'), 80)"
FILE_NAMES_OUT = f"""SELECT DISTINCT identifier, left(concat_ws('_', nullif({_san(_sur)}, ''), "year"::VARCHAR, nullif({_san('title')}, ''), nullif(coalesce(volume_sig, ''), '')), 196) || '.txt' file_name FROM bibliography"""
_sig_title = "CASE " + " ".join(f"WHEN regexp_extract(lower(title), '{p}', 1) <> '' THEN '{k}' || " + _num(f"regexp_extract(lower(title), '{p}', 1)") for k, p in VOLUME) + " ELSE '' END"
ENRICH = f"""WITH l AS (SELECT identifier, title, creator, "year", publisher, txt_url FROM bibliography QUALIFY {_latest('title', 'creator', '"year"', 'publisher', 'txt_url')}),
j AS (SELECT DISTINCT b.identifier, harvested_at, coalesce(l.title, b.title) title, coalesce(l."year", b."year") "year", coalesce(l.publisher, b.publisher) publisher, coalesce(l.txt_url, b.txt_url) txt_url FROM bibliography b LEFT JOIN l ON l.identifier = b.identifier)
SELECT *, {_sig_title} volume_sig FROM j WHERE coalesce(txt_url, '') <> ''"""
MIRROR = f"WITH {_sets(2)} SELECT a, b, n FROM pr UNION ALL SELECT b, a, n FROM pr"
ESSENTIAL_BY_O = f"WITH {_LAB} SELECT o_label, count(*) n, count(*) FILTER (is_essentializing) essential, avg(list_has_any({_az('context_text')}, {_list(L.VERBS['fight'])})::INT) fight_share FROM lab GROUP BY 1"
SUMMARY_STATS = f"""WITH {_LAB} SELECT 'mentions' metric, count(*)::DOUBLE "value" FROM lab UNION ALL SELECT 'entities', count(DISTINCT ethnos_norm) FROM lab UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM lab
UNION ALL SELECT 'noise', count(*) FILTER (is_noise) FROM lab UNION ALL SELECT 'essential', count(*) FILTER (is_essentializing) FROM lab"""
DIGEST = f"WITH {_LAB}, dd AS (" + " UNION ALL ".join(f"SELECT '{c}' dimension, {k} most, {c} \"value\", count(*) n FROM cl WHERE {c} IS NOT NULL GROUP BY {c}" for c, k in (("ethnos_norm", 5), ("r_label", 3), ("o_label", 3))) + '), rr AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, "value")::INT "rank" FROM dd) SELECT dimension, "value", n, "rank" FROM rr WHERE "rank" <= most'
R_BY_ENTITY = f"WITH {_LAB} SELECT ethnos_norm, count(*) n, count(*) FILTER (r_label = 'negative') negative, count(*) FILTER (r_label = 'exotic') exotic, least(3, count(DISTINCT mention_id) FILTER (r_label = 'negative'))::INT examples FROM cl WHERE ethnos_norm IN (SELECT DISTINCT canonical FROM lexicon_entities ORDER BY 1 LIMIT 5) GROUP BY 1"
NOISE_ENTITY = f"WITH {_RAW} SELECT mention_id, doc_id, sent_idx, ethnos_norm, noise_reason FROM raw WHERE is_noise AND ethnos_norm IS NOT NULL"
FRAGMENTS = f"WITH {_LAB} SELECT mention_id, file_name, sent_idx, ethnos_norm, r_label, r_confidence, o_label, o_confidence, noise_reason, coalesce(file_name, '') || '#' || sent_idx pointer, '' manual_r, '' manual_o, '' manual_note, '' manual_check FROM cl"
