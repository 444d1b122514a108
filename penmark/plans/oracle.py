"""DuckDB SQL for the registered queries, written apart from the Spark jobs."""

from __future__ import annotations

import math

from penmark.functions.tukey import HART_ABOVE, HART_BELOW, OUTER, inner_nodes, nodes
from penmark.operators.corpus import WING_SCHEMES
from penmark.operators.lexicon import MACROS
from penmark.plans.feature_sets import method_name, series
from penmark.sources.sample import LEXICON_WORDS, PARTIES
from penmark.sources.words import function_word_list


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_text(v) for v in values)


# ---- shared parts ----------------------------------------------------------

_PARTY = "CASE k % 7 " + " ".join(f"WHEN {i} THEN {_text(p)}" for i, p in enumerate(PARTIES)) + " END"


def _wing(scheme: str, party: str = "party") -> str:
    whens = " ".join(f"WHEN {party} IN ({_list(m)}) THEN {_text(w)}" for w, m in WING_SCHEMES[scheme].items())
    return f"CASE {whens} END"


# The lexicon blocks whose grams are chosen by chi-square.
_SELECTED = ("gram", "obj", "cog", "feels")

_ENGLISH = "CASE {w} WHEN 'Izquierda' THEN 'Left' WHEN 'Derecha' THEN 'Right' WHEN 'Centro' THEN 'Centre' ELSE 'Regionalist' END"
_WORD = r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*"

_UPOS = """CASE
  WHEN w IN ('el','la','los','las','un','una','the','a','le','les','des','der','die','das') THEN 'DET'
  WHEN w IN ('de','en','con','of','in','to','for','pour','mit','por','von') THEN 'ADP'
  WHEN w IN ('yo','me','je','nous','tu','vous','you','it','they','elle','qui') THEN 'PRON'
  WHEN w IN ('and','y','et','und','or','que') THEN 'CCONJ'
  WHEN w IN ('is','was','be','ist','es','have') THEN 'AUX'
  WHEN w IN ('not','no','nicht','as','mas') THEN 'ADV'
  WHEN regexp_matches(w, '[0-9]') THEN 'NUM'
  WHEN regexp_matches(w, '(ing|ed|er|ar|ir|en|ez)$') THEN 'VERB'
  WHEN regexp_matches(w, '(able|ble|al|if|ivo|iva|lich|ly|oso|eux)$') THEN 'ADJ'
  WHEN length(w) = 1 THEN 'X' ELSE 'NOUN' END"""

# Lowercase letters outside category Ll, as ª and º.
_OTHER_LOWER = "ªºʰ-ʸˀˁˠ-ˤᴬ-ᵪᵸᶛ-ᶿⁱⁿₐ-ₜⅰ-ⅿⓐ-ⓩⱼⱽ"


def _all_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}{_OTHER_LOWER}]'))"


_NUCLEUS = "[iuü]?[aeoáéó][iuü]?|[iuü]+|[íú]"


def _lexicon_ctes() -> dict[str, str]:
    lines, cats = [], []
    for line, (entry, names) in enumerate(LEXICON_WORDS):
        lines += [f"({line}, {_text(entry)}, {pos}, {_text(name)})" for pos, name in enumerate(names)]
    for macro, names in MACROS.items():
        cats += [f"({_text(macro)}, {_text(name)})" for name in names]
    codes = ", ".join(
        f"coalesce(string_agg(name, '' ORDER BY pos) FILTER (WHERE name IN (SELECT name FROM macro_names WHERE macro = {_text(m)})), 'w') AS {m}"
        for m in MACROS
    )
    return {
        "lex_lines": f"SELECT * FROM (VALUES {', '.join(lines)}) AS t(line_no, entry, pos, name)",
        "macro_names": f"SELECT * FROM (VALUES {', '.join(cats)}) AS t(macro, name)",
        "lexicon": f"""SELECT entry, {codes} FROM lex_lines l
            WHERE line_no = (SELECT max(line_no) FROM lex_lines m WHERE m.entry = l.entry) GROUP BY entry""",
    }


def _pieces() -> dict[str, str]:
    weak = _list(function_word_list("es"))
    stress = f"""CASE WHEN n = 0 THEN '' WHEN n = 1 AND w IN ({weak}) THEN '-'
        ELSE repeat('-', k - 1) || '+' || repeat('-', n - k) END"""
    return {
        "speeches": f"""SELECT doc_id AS speech_id, source AS speaker, {_PARTY} AS party,
            CASE WHEN doc_id % 17 = 0 THEN 'Chairperson' WHEN doc_id % 17 = 1 THEN NULL ELSE 'Regular' END AS role,
            CASE WHEN (k + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
            CAST(1940 + (k * 7) % 45 AS INTEGER) AS birth,
            CASE WHEN doc_id % 3 = 0 THEN 'Opposition' ELSE 'Coalition' END AS party_status,
            CASE WHEN doc_id % 97 = 3 THEN NULL ELSE text END AS text
            FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS k FROM documents)""",
        "toks": rf"SELECT *, coalesce(regexp_extract_all(lower(text), '{_WORD}'), []) AS tokens FROM speeches",
        "words": "SELECT speech_id, speaker, unnest(tokens) AS w, unnest(range(len(tokens))) AS pos FROM toks",
        "vocab": "SELECT DISTINCT w FROM words",
        **_lexicon_ctes(),
        "matched": """SELECT w, max_by(entry, rank) AS entry FROM (
              SELECT v.w, l.entry, 1000 AS rank FROM vocab v JOIN lexicon l ON v.w = l.entry
              UNION ALL
              SELECT v.w, l.entry, length(l.entry) AS rank FROM vocab v JOIN lexicon l
                ON l.entry LIKE '%*' AND starts_with(v.w, left(l.entry, length(l.entry) - 1)))
            GROUP BY w""",
        "coded": "SELECT m.w, l.* FROM matched m JOIN lexicon l USING (entry)",
        "tagged_words": f"SELECT w, {_UPOS} AS upos FROM vocab",
        "tagged": """SELECT t.speech_id, coalesce(p.pos_tags, '') AS pos_tags FROM toks t LEFT JOIN (
              SELECT speech_id, string_agg(upos, ' ' ORDER BY pos) AS pos_tags
              FROM words JOIN tagged_words USING (w) GROUP BY speech_id) p USING (speech_id)""",
        "stress_words": f"""SELECT w, {stress} AS s FROM (
              SELECT w, len(nuc) AS n,
                CASE WHEN len(list_filter(nuc, lambda x: regexp_matches(x, '[áéíóú]'))) > 0
                       THEN list_position(list_transform(nuc, lambda x: regexp_matches(x, '[áéíóú]')), true)
                     WHEN regexp_matches(w, '[aeiouáéíóúüns]$') THEN greatest(len(nuc) - 1, 1)
                     ELSE len(nuc) END AS k
              FROM (SELECT w, regexp_extract_all(w, '{_NUCLEUS}') AS nuc FROM vocab))""",
        "stressed": """SELECT t.speech_id, coalesce(p.stress, '') AS stress FROM toks t LEFT JOIN (
              SELECT speech_id, string_agg(s, '' ORDER BY pos) AS stress
              FROM words JOIN stress_words USING (w) GROUP BY speech_id) p USING (speech_id)""",
        # corpus
        "nochair": "SELECT * FROM speeches WHERE role IS DISTINCT FROM 'Chairperson'",
        "bigparty": """SELECT * FROM nochair WHERE party IN
              (SELECT party FROM nochair WHERE party IS NOT NULL GROUP BY party HAVING count(*) >= 120)""",
        "four": f"""SELECT *, {_wing('four')} AS wing FROM bigparty
              WHERE len(regexp_extract_all(text, '\\S+')) > 50""",
        "six": f"SELECT *, {_wing('six')} AS wing FROM bigparty",
        "two": f"SELECT * FROM (SELECT *, {_wing('two')} AS wing FROM bigparty) WHERE wing IN ('Izquierda', 'Derecha')",
        **{
            f"top_{s}": f"""SELECT wing, speaker, n, r AS rank FROM (SELECT wing, speaker, count(*) AS n,
                row_number() OVER (PARTITION BY wing ORDER BY count(*) DESC, speaker) AS r
                FROM {s} WHERE wing IS NOT NULL GROUP BY wing, speaker) WHERE r <= 5"""
            for s in ("four", "six", "two")
        },
        "top_all": "SELECT speaker, count(*) AS n FROM six GROUP BY speaker ORDER BY n DESC, speaker LIMIT 20",
        "c4": "SELECT * FROM four WHERE speaker IN (SELECT speaker FROM top_four) AND text <> ''",
        "c6": "SELECT * FROM six WHERE speaker IN (SELECT speaker FROM top_six) AND text <> ''",
        "p2": "SELECT * FROM two WHERE speaker IN (SELECT speaker FROM top_two)",
        "p0": "SELECT * FROM six WHERE speaker IN (SELECT speaker FROM top_all)",
        **{
            f"bal_{s}": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY speaker
                ORDER BY md5('42:' || speech_id), speech_id) AS rn FROM {s})
                WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {s} GROUP BY speaker))"""
            for s in ("p2", "p0")
        },
        "c2": "SELECT * FROM bal_p2 WHERE text <> ''",
        "c0": "SELECT * FROM bal_p0 WHERE text <> ''",
        "winged": f"SELECT *, {_wing('four')} AS wing FROM speeches",
        "modal": """SELECT speaker, kind, CASE WHEN kind = 'birth'
                THEN CAST(CAST(round_even(CAST(label AS INTEGER) / 10.0, 0) * 10 AS INTEGER) AS VARCHAR) ELSE label END AS label
              FROM (SELECT speaker, kind, label, row_number() OVER (PARTITION BY speaker, kind ORDER BY count(*) DESC, label) AS r
                FROM (SELECT speaker, unnest(['wing', 'party', 'birth', 'gender']) AS kind,
                        unnest([wing, party, CAST(birth AS VARCHAR), gender]) AS label FROM winged)
                WHERE label IS NOT NULL GROUP BY speaker, kind, label) WHERE r = 1""",
        # features
        "function_words": f"SELECT unnest([{weak}]) AS w, unnest(range({len(function_word_list('es'))})) AS place",
        "side": """SELECT speech_id, party AS y, CASE WHEN speaker IS NOT NULL AND row_number() OVER (PARTITION BY speaker
              ORDER BY md5('42:' || speech_id), speech_id) <= 30 THEN 'train' ELSE 'test' END AS side FROM speeches""",
        "pos_units": """SELECT speech_id, w, row_number() OVER (PARTITION BY speech_id ORDER BY pos) AS i FROM (
              SELECT speech_id, pos, lower(upos) AS w FROM words JOIN tagged_words USING (w)) WHERE length(w) >= 2""",
        **{
            f"{m}_units": f"""SELECT speech_id, w, row_number() OVER (PARTITION BY speech_id ORDER BY pos) AS i FROM (
              SELECT speech_id, pos, lower(coalesce({m}, 'w')) AS w FROM words LEFT JOIN coded USING (w)) WHERE length(w) >= 2"""
            for m in _SELECTED
        },
        **{f"{b}_grams": _word_grams(f"{b}_units") for b in ("pos", *_SELECTED)},
        "stress_grams": """SELECT speech_id, g AS gram, count(*) AS tf FROM (
              SELECT speech_id, substr(stress, i, n) AS g FROM (
                SELECT speech_id, stress, n, unnest(range(1, length(stress) - n + 2)) AS i FROM (
                  SELECT speech_id, stress, unnest(range(1, 8)) AS n FROM stressed)))
              GROUP BY speech_id, g""",
        **{f"{b}_df": f"SELECT gram, count(*) AS df FROM {b}_grams GROUP BY gram" for b in ("pos", "gram", "stress")},
        **{
            f"{b}_train_df": f"""SELECT gram, count(*) AS df FROM {b}_grams JOIN side USING (speech_id)
                WHERE side = 'train' GROUP BY gram"""
            for b in ("pos", "stress", *_SELECTED)
        },
        **{f"{b}_tfidf": _tfidf(f"{b}_grams", f"{b}_df", "(SELECT count(*) FROM speeches)") for b in ("pos", "gram", "stress")},
        **{
            f"{b}_fit_tfidf": _tfidf(f"{b}_grams", f"{b}_train_df", "(SELECT count(*) FROM side WHERE side = 'train')")
            for b in ("pos", "stress", *_SELECTED)
        },
        "gram_chi2": _chi2("SELECT t.gram, t.v, s.party AS y FROM gram_tfidf t JOIN speeches s USING (speech_id)",
                           "SELECT party AS y FROM speeches"),
        **{
            f"{m}_fit_chi2": _chi2(f"SELECT t.gram, t.v, s.y FROM {m}_fit_tfidf t JOIN side s USING (speech_id) WHERE side = 'train'",
                                   "SELECT y FROM side WHERE side = 'train'")
            for m in _SELECTED
        },
        **{
            f"{m}_best": f"""SELECT gram FROM (SELECT *, row_number() OVER (ORDER BY round(chi2, 9) DESC, gram DESC) AS r FROM {m}_fit_chi2)
              WHERE r <= floor(0.1 * (SELECT count(*) FROM {m}_train_df))"""
            for m in _SELECTED
        },
        "word_hist": "SELECT speech_id, length(w) AS len, count(*) AS n FROM words GROUP BY ALL",
        "sents": r"""SELECT speech_id, len(regexp_extract_all(lower(s), '[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*')) AS len FROM (
              SELECT speech_id, trim(unnest(regexp_split_to_array(text, '[.!?]+\s+|\n+'))) AS s FROM speeches) WHERE s <> ''""",
        "sent_hist": "SELECT speech_id, len, count(*) AS n FROM sents GROUP BY ALL",
        **{f"{h}_curve": _curve(f"{h}_hist", "1 = 1") for h in ("word", "sent")},
        **{
            f"{h}_fit_curve": _curve(f"{h}_hist", "speech_id IN (SELECT speech_id FROM side WHERE side = 'train')")
            for h in ("word", "sent")
        },
        "fw_values": """SELECT speech_id, w, n / sqrt(sum(n * n) OVER (PARTITION BY speech_id)) AS v FROM (
              SELECT speech_id, w, CAST(count(*) AS DOUBLE) AS n FROM words WHERE w IN (SELECT w FROM function_words) GROUP BY ALL)""",
        # scores
        "preds": """SELECT 'demo' AS run, task_label, d.doc_id AS speech_id, d.source AS speaker,
              CAST(truth AS VARCHAR) AS y_true, method,
              CAST(CASE method WHEN 'LENGTH' THEN CAST(n_chars > 1000 AS INTEGER)
                WHEN 'RULE' THEN CAST(d.doc_id % 5 <> 0 AS INTEGER)
                ELSE CASE WHEN d.doc_id % 11 = 0 THEN 1 - truth ELSE truth END END AS VARCHAR) AS y_pred
              FROM (SELECT doc_id, 'quality' AS task_label, quality AS truth FROM labels
                    UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l
              JOIN documents d USING (doc_id), (SELECT unnest(['LENGTH', 'RULE', 'ORACLE11']) AS method)""",
        "scores": """SELECT run, task_label, method, label, tp, fp, fn,
                CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM (
              SELECT run, task_label, method, label,
                count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp,
                count(*) FILTER (WHERE y_true <> label AND y_pred = label) AS fp,
                count(*) FILTER (WHERE y_true = label AND y_pred <> label) AS fn
              FROM preds, (SELECT unnest(['0', '1']) AS label) GROUP BY ALL) WHERE tp + fp + fn > 0""",
        "f1s": "SELECT run, task_label, method, round_even(f1, 3) AS f1 FROM f1b",
        "model_preds": """SELECT doc_id, method, d.lang AS y_true, s.lang AS y_pred FROM documents d
            JOIN (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) t USING (lang),
            (VALUES ('ALL', 11), ('ALL - POS', 7), ('BaseFeatures', 3), ('MODEL_MASKED', 13), ('MODEL_PLAIN', 5)) e(method, errs)
            JOIN (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) s
              ON s.code = CASE WHEN doc_id % errs = 0 THEN (t.code + 1) % t.k ELSE t.code END""",
        "model_scores": """SELECT method, round_even(avg(2.0 * tp / (truth + said)), 3) AS macro_f1, round_even(2.0 * sum(tp) / sum(truth + said), 3) AS micro_f1 FROM (
            SELECT method, label, sum(t) AS truth, sum(p) AS said, sum(h) AS tp FROM (
              SELECT method, y_true AS label, 1 AS t, 0 AS p, CAST(y_true = y_pred AS INTEGER) AS h FROM model_preds
              UNION ALL SELECT method, y_pred, 0, 1, 0 FROM model_preds) GROUP BY ALL) GROUP BY method""",
        "f1b": """SELECT run, task_label, method, f1 FROM scores WHERE label = '1'
              UNION ALL SELECT DISTINCT run, task_label, method, 0.0 FROM preds p WHERE NOT EXISTS (
                SELECT 1 FROM scores s WHERE label = '1' AND s.task_label = p.task_label AND s.method = p.method)""",
        "results": """SELECT task_label, method, speaker, round(CASE WHEN 2 * tp + wrong = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + wrong) END, 3) AS f1 FROM (
              SELECT task_label, method, speaker, count(*) FILTER (WHERE y_true = '1' AND y_pred = '1') AS tp,
                count(*) FILTER (WHERE (y_true = '1') <> (y_pred = '1')) AS wrong
              FROM preds GROUP BY task_label, method, speaker)""",
        "grouped": """SELECT r.*, m.kind, m.label AS grp FROM results r JOIN modal m USING (speaker)
              JOIN (SELECT kind, label FROM modal GROUP BY ALL HAVING count(*) > 1) USING (kind, label)""",
        "indexed": """SELECT r.*, style, idx FROM results r JOIN (UNPIVOT (SELECT speaker, ati, cni, asi, pos_minus_neg, pos_plus_neg FROM style)
              ON ati, cni, asi, pos_minus_neg, pos_plus_neg INTO NAME style VALUE idx) USING (speaker)""",
        "aov": _anova("grouped", "f1"),
        **_range_nodes(),
        "style": _style("speaker"),
        "style_texts": _style("speech_id"),
        "utter": rf"""SELECT regexp_extract(sent_id, '^(.*?\.u[0-9]*)', 1) AS utterance_id, turn, clean, text FROM (
              SELECT 'C' || conv_id || '.u' || conv_id || '.s' || turn AS sent_id, turn, text,
                lower(replace(replace(translate(text, 'äïö', 'aio'), '¿', '¿ '), '¡', '¡ ')) AS clean FROM conversations)
              WHERE NOT {_all_upper('text')}""",
    }


def _word_grams(units: str) -> str:
    return f"""SELECT speech_id, gram, count(*) AS tf FROM (
          SELECT speech_id, w AS gram FROM {units}
          UNION ALL SELECT a.speech_id, a.w || ' ' || b.w FROM {units} a JOIN {units} b ON a.speech_id = b.speech_id AND b.i = a.i + 1
          UNION ALL SELECT a.speech_id, a.w || ' ' || b.w || ' ' || c.w FROM {units} a
            JOIN {units} b ON a.speech_id = b.speech_id AND b.i = a.i + 1
            JOIN {units} c ON a.speech_id = c.speech_id AND c.i = a.i + 2)
        GROUP BY speech_id, gram"""


def _tfidf(grams: str, df: str, n: str) -> str:
    return f"""SELECT speech_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY speech_id)) AS v FROM (
          SELECT speech_id, gram, (1 + ln(tf)) * (ln((1 + {n}) / (1.0 + df)) + 1) AS w FROM {grams} JOIN {df} USING (gram))"""


def _chi2(weights: str, labels: str) -> str:
    return f"""SELECT gram, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2 FROM (
          SELECT t.gram, o.o, t.f * c.p AS e
          FROM (SELECT gram, sum(v) AS f FROM ({weights}) GROUP BY gram) t
          CROSS JOIN (SELECT y, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM ({labels})) AS p FROM ({labels}) GROUP BY y) c
          LEFT JOIN (SELECT gram, y, sum(v) AS o FROM ({weights}) GROUP BY gram, y) o ON o.gram = t.gram AND o.y = c.y)
        GROUP BY gram"""


def _curve(hist: str, fit_on: str) -> str:
    return f"""SELECT speech_id, i, s / sqrt(sum(s * s) OVER (PARTITION BY speech_id)) AS v FROM (
          SELECT h.speech_id, g.i, CAST(sum(n) FILTER (WHERE len >= i) AS DOUBLE) AS s FROM {hist} h,
            (SELECT unnest(range(1, (SELECT max(len) + 1 FROM (SELECT len FROM {hist} WHERE {fit_on}
               GROUP BY len HAVING sum(n) >= 5)))) AS i) g GROUP BY ALL) WHERE s > 0"""


def _style(by: str) -> str:
    def sub(column, name):
        return f"coalesce(sum((length({column}) - length(replace({column}, '{name}', ''))) // {len(name)}), 0)"

    cdi = ["Articulo", "Prepos", "PronPer", "PronImp", "VerbAux", "Conjunc", "Adverb", "Negacio"]
    parts = [sub("cdi", n) + f" AS {n}" for n in cdi]
    parts += [sub("gram", n) + f" AS {n}" for n in ("Yo", "Nosotro", "TuUtd", "VosUtds")]
    parts += [sub("feels", n) + f" AS {n}" for n in ("EmoPos", "EmoNeg")]
    parts += [f"count(*) FILTER (WHERE upos = '{t}') AS {t}" for t in ("NOUN", "ADJ", "VERB")]
    return f"""SELECT {by}, n_words,
          100.0 * (Articulo + Prepos - PronPer - PronImp - VerbAux - Conjunc - Adverb - Negacio) / nullif(n_words, 0) AS ati,
          100.0 * (NOUN + ADJ + Prepos - VERB - Adverb - PronPer) / nullif(n_words, 0) AS cni,
          (VosUtds + TuUtd) / nullif(CAST(Nosotro + Yo + VosUtds + TuUtd AS DOUBLE), 0) AS asi,
          100.0 * (EmoPos - EmoNeg) / nullif(n_words, 0) AS pos_minus_neg,
          100.0 * (EmoPos + EmoNeg) / nullif(n_words, 0) AS pos_plus_neg
        FROM (SELECT {by}, coalesce(sum(len(regexp_extract_all(text, '\\S+'))), 0) AS n_words FROM speeches GROUP BY {by}) n
        LEFT JOIN (SELECT s.{by} AS key_, {', '.join(parts)}
              FROM words s LEFT JOIN coded USING (w) JOIN tagged_words USING (w) GROUP BY s.{by}) ON key_ = {by}"""


def _simpson(low: str, high: str, f) -> str:
    x = f"({low} + i * ({high} - {low}) / 1000.0)"
    weight = "CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, 1001), lambda i: {weight} * {f(x)})) * ({high} - {low}) / 3000.0)"


def _f_tail(stat: str, d1: str, d2: str) -> str:
    """Tail of F in the form u = asin(sqrt(d2 / (d2 + d1 F))), integrated to u and to pi/2."""
    body = lambda u: f"pow(sin({u}), {d2} - 1) * pow(abs(cos({u})), {d1} - 1)"
    h = f"asin(sqrt({d2} / ({d2} + {d1} * {stat})))"
    return f"({_simpson('0.0', h, body)} / {_simpson('0.0', str(math.pi / 2), body)})"


def _range_tail() -> str:
    """Tail of the studentized range for columns q, k, df: the two sums of the expression, over lists of its nodes."""
    horner = lambda c, x: f"({c[0]})" if len(c) == 1 else f"({horner(c[:-1], x)} * {x} + {c[-1]})"
    x = "least(abs(v), 7.07106781186547)"
    tail = f"CASE WHEN abs(v) >= 7.07106781186547 THEN 0.0 ELSE exp(-{x} * {x} / 2) * {horner(HART_ABOVE, x)} / {horner(HART_BELOW, x)} END"
    cdf = f"list_transform(list_transform(zs, lambda z: z - q * s), lambda v: CASE WHEN v > 0 THEN 1 - {tail} ELSE {tail} END)"
    return f"""SELECT *, CASE WHEN q <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - a / b)) END AS p FROM (
        SELECT task_label, kind, method, group_a, group_b, sum(d * inside) AS a, sum(d) AS b FROM (
          SELECT *, k * list_sum(list_transform(range(1, len(zs) + 1), lambda i: ws[i] * pow(greatest(bs[i] - cs[i], 0.0), k - 1))) AS inside FROM (
            SELECT *, {cdf} AS cs, w * exp((df - 1) * ln(s) - df * (s * s - 1) / 2) AS d FROM (
              SELECT *, (hi + lo) / 2 + (hi - lo) / 2 * x AS s FROM (
                SELECT *, greatest(1e-9, 1 - 10 / sqrt(2 * df)) AS lo, 1 + (CASE WHEN df > 4 THEN 10 ELSE 14 END) / sqrt(2 * df) AS hi FROM pairs),
                range_outer, range_inner)))
        GROUP BY ALL) JOIN pairs USING (task_label, kind, method, group_a, group_b)"""


def _range_nodes() -> dict[str, str]:
    x, w = nodes(OUTER)
    outer = ", ".join(f"({a!r}, {b!r})" for a, b in zip(x, w))
    zs, ws, bs = (f"[{', '.join(repr(v) for v in part)}]" for part in inner_nodes())
    return {
        "range_outer": f"SELECT * FROM (VALUES {outer}) AS t(x, w)",
        "range_inner": f"SELECT {zs}::DOUBLE[] AS zs, {ws}::DOUBLE[] AS ws, {bs}::DOUBLE[] AS bs",
        "pairs": """SELECT a.task_label, a.kind, a.method, a.grp AS group_a, b.grp AS group_b, b.m - a.m AS mean_diff, k, df_within AS df,
            abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q
            FROM (SELECT task_label, kind, method, grp, avg(f1) AS m, count(*) AS n FROM grouped GROUP BY ALL) a
            JOIN (SELECT task_label, kind, method, grp, avg(f1) AS m, count(*) AS n FROM grouped GROUP BY ALL) b
              ON a.task_label = b.task_label AND a.kind = b.kind AND a.method = b.method AND a.grp < b.grp
            JOIN aov ON aov.task_label = a.task_label AND aov.kind = a.kind AND aov.method = a.method""",
    }


def _anova(rows: str, v: str) -> str:
    return f"""SELECT task_label, kind, method, k, n, k - 1 AS df_between, n - k AS df_within, ssw / (n - k) AS mse,
          (ssb / (k - 1)) / (ssw / (n - k)) AS f_stat FROM (
            SELECT task_label, kind, method, count(DISTINCT grp) AS k, count(*) AS n, sum(({v} - gm) * ({v} - gm)) AS ssw,
              sum((gm - m) * (gm - m)) AS ssb FROM (
                SELECT *, avg({v}) OVER (PARTITION BY task_label, kind, method, grp) AS gm,
                  avg({v}) OVER (PARTITION BY task_label, kind, method) AS m FROM {rows})
            GROUP BY ALL)"""


def _needed(body: str, pieces: dict[str, str]) -> list[str]:
    """The named parts a text uses, in definition order."""
    import re

    found: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[A-Za-z_0-9]+", todo.pop()))
        for name in pieces:
            if name in words and name not in found:
                found.add(name)
                todo.append(pieces[name])
    return [n for n in pieces if n in found]


def sql_queries() -> dict[str, str]:
    pieces = _pieces()
    out = {}
    for name, body in _bodies().items():
        used = _needed(body, pieces)
        order = _topological(used, pieces)
        ctes = ", ".join(f"{n} AS MATERIALIZED ({pieces[n]})" for n in order)
        out[name] = (f"WITH {ctes} " if ctes else "") + body
    return out


def _topological(names: list[str], pieces: dict[str, str]) -> list[str]:
    done: list[str] = []

    def visit(name):
        if name in done:
            return
        for other in _needed(pieces[name], pieces):
            if other != name and other in names:
                visit(other)
        done.append(name)

    for name in names:
        visit(name)
    return done


_R = lambda expr, name, places=6: f"round({expr}, {places}) AS {name}"


def _bodies() -> dict[str, str]:
    style_cols = ", ".join(_R(c, c) for c in ("ati", "cni", "asi", "pos_minus_neg", "pos_plus_neg"))
    ids = "speech_id, speaker, party, wing"
    p_exact = """least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(yn, ny) AS BIGINT) + 1), lambda i: 
        exp(lgamma(yn + ny + 1) - lgamma(i + 1) - lgamma(yn + ny - i + 1) - (yn + ny) * ln(2)))))"""
    cells = """SELECT a.run, a.task_label, a.method AS baseline, b.method,
        count(*) FILTER (WHERE a.y_true = a.y_pred AND b.y_true = b.y_pred) AS yy,
        count(*) FILTER (WHERE a.y_true = a.y_pred AND b.y_true <> b.y_pred) AS yn,
        count(*) FILTER (WHERE a.y_true <> a.y_pred AND b.y_true = b.y_pred) AS ny,
        count(*) FILTER (WHERE a.y_true <> a.y_pred AND b.y_true <> b.y_pred) AS nn
        FROM preds a JOIN preds b USING (task_label, speech_id) {where} GROUP BY ALL"""
    sets = ", ".join(f"({i}, {_text(method_name(s))})" for i, s in enumerate(series()))
    ranks = """SELECT task_label, method, style, rank() OVER (PARTITION BY task_label, method, style ORDER BY f1)
          + (count(*) OVER (PARTITION BY task_label, method, style, f1) - 1) / 2.0 AS ry,
        rank() OVER (PARTITION BY task_label, method, style ORDER BY idx)
          + (count(*) OVER (PARTITION BY task_label, method, style, idx) - 1) / 2.0 AS rx FROM indexed"""
    return {
        "text_clean": """SELECT doc_id AS speech_id, lower(replace(replace(translate(text, 'äïö', 'aio'), '¿', '¿ '), '¡', '¡ ')) AS clean
            FROM documents""",
        "drop_chair": "SELECT speech_id, role FROM nochair",
        "party_min_rows": "SELECT speech_id, party FROM bigparty",
        "min_words": r"SELECT speech_id, len(regexp_extract_all(text, '\S+')) AS n_words FROM speeches WHERE len(regexp_extract_all(text, '\S+')) > 50",
        "uppercase_sentences": "SELECT doc_id AS speech_id FROM documents WHERE " + _all_upper("text"),
        "wing_assign": f"""SELECT speech_id, {_wing('four')} AS wing_four, {_wing('six')} AS wing_six, {_wing('two')} AS wing_two,
            {_ENGLISH.format(w='(' + _wing('four') + ')')} AS wing_en FROM speeches""",
        "top_speakers_per_wing": "SELECT * FROM top_four",
        "top_speakers": "SELECT speaker, n FROM top_all",
        "selected_speeches": "SELECT speech_id, speaker, wing FROM six WHERE speaker IN (SELECT speaker FROM top_six)",
        "balanced_sample": "SELECT speech_id, speaker FROM bal_p2",
        "corpus_4wings": f"SELECT {ids} FROM c4",
        "corpus_6wings": f"SELECT {ids} FROM c6",
        "corpus_2wings": f"SELECT {ids} FROM c2",
        "corpus_nowing": f"SELECT {ids} FROM c0",
        "corpus_totals": """SELECT count(*) AS n_samples,
            count(DISTINCT party) + max(CAST(party IS NULL AS BIGINT)) AS n_parties,
            count(DISTINCT wing) + max(CAST(wing IS NULL AS BIGINT)) AS n_wings,
            string_agg(DISTINCT party, ',' ORDER BY party) AS parties, string_agg(DISTINCT wing, ',' ORDER BY wing) AS wings FROM winged""",
        "corpus_by_speaker": r"""SELECT speaker, count(*) AS n_samples,
            CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words FROM speeches GROUP BY speaker""",
        "modal_label": "SELECT * FROM modal",
        "author_categories": "SELECT kind, label AS value, count(*) AS n_authors FROM modal WHERE kind <> 'wing' GROUP BY ALL",
        "pattern_count": "SELECT speaker, CAST(coalesce(sum((length(text) - length(replace(text, 'de', ''))) // 2), 0) AS BIGINT) AS n FROM speeches GROUP BY speaker",
        "party_status_rows": """SELECT speech_id, speaker, party_status FROM speeches
            WHERE NOT (speaker IS NOT DISTINCT FROM 'src0' AND party_status IS DISTINCT FROM 'Opposition')""",
        "label_codes": "SELECT speech_id, party AS y, CAST(dense_rank() OVER (ORDER BY party) - 1 AS INTEGER) AS code FROM speeches",
        "utterances": "SELECT utterance_id, string_agg(clean, ' ' ORDER BY turn) AS text FROM utter GROUP BY utterance_id",
        "speech_table": rf"""SELECT 'C' || conv_id || '.u' || conv_id AS speech_id, 'R' || (conv_id % 5) AS speaker,
            CAST(1940 + conv_id % 45 AS INTEGER) AS birth, coalesce(t.text, '') AS text, coalesce(t.pos_tags, '') AS pos_tags
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (
              SELECT conv_id, string_agg(clean, ' ' ORDER BY turn) AS text, string_agg(tags, ' ' ORDER BY turn) AS pos_tags FROM (
                SELECT conv_id, turn, lower(replace(replace(translate(line, 'äïö', 'aio'), '¿', '¿ '), '¡', '¡ ')) AS clean,
                  array_to_string(list_transform(regexp_extract_all(lower(line), '{_WORD}'), lambda w: {_UPOS}), ' ') AS tags
                FROM (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS line FROM conversations)
                WHERE NOT {_all_upper('line')})
              GROUP BY conv_id) t USING (conv_id)""",
        "metadata_layouts": """SELECT 'D' || doc_id AS id, source AS speaker, CASE WHEN doc_id % 3 < 2 THEN lang END AS party,
            CAST(1900 + doc_id % 100 AS INTEGER) AS birth FROM documents WHERE doc_id IS NOT NULL""",
        "lexicon_from_file": """SELECT entry, gram, cdi, feels, count(*) AS n_words FROM words JOIN coded USING (w) GROUP BY ALL""",
        "token_stats": r"""SELECT t.speech_id, len(tokens) AS n_tokens, coalesce(len(regexp_extract_all(text, '\S+')), 0) AS n_words,
            coalesce(s.n, 0) AS n_sentences FROM toks t LEFT JOIN (SELECT speech_id, count(*) AS n FROM sents GROUP BY 1) s USING (speech_id)""",
        "function_word_freq": f"SELECT speech_id, w AS feature, {_R('v', 'value')} FROM fw_values",
        "word_length_curve": f"SELECT speech_id, i, {_R('v', 'value')} FROM word_curve",
        "sentence_length_curve": f"SELECT speech_id, i, {_R('v', 'value')} FROM sent_curve",
        "lexicon_match": "SELECT w AS word, entry, gram, obj, cog, feels, cdi FROM vocab LEFT JOIN coded USING (w)",
        "lexicon_encode": "SELECT t.speech_id, " + ", ".join(f"coalesce({m}, '') AS {m}" for m in MACROS)
        + " FROM toks t LEFT JOIN (SELECT speech_id, "
        + ", ".join(f"string_agg(coalesce({m}, 'w'), ' ' ORDER BY pos) AS {m}" for m in MACROS)
        + " FROM words LEFT JOIN coded USING (w) GROUP BY speech_id) p USING (speech_id)",
        "pos_text": "SELECT speech_id, pos_tags FROM tagged",
        "stress_encode": "SELECT speech_id, stress FROM stressed",
        "word_ngram_df": "SELECT gram, df FROM pos_df",
        "char_ngram_df": "SELECT gram, df FROM stress_df",
        "tfidf_word": f"SELECT speech_id, gram, {_R('v', 'value')} FROM pos_tfidf",
        "tfidf_char": f"SELECT speech_id, gram, {_R('v', 'value')} FROM stress_tfidf",
        "tfidf_test_side": f"SELECT speech_id, gram, {_R('v', 'value')} FROM pos_fit_tfidf JOIN side USING (speech_id) WHERE side = 'test'",
        "chi2_scores": f"SELECT gram, {_R('chi2', 'chi2')} FROM gram_chi2",
        "chi2_top": f"""SELECT gram, {_R('chi2', 'chi2')} FROM (SELECT *, row_number() OVER (ORDER BY round(chi2, 9) DESC, gram DESC) AS r
            FROM gram_chi2) WHERE r <= floor(0.1 * (SELECT count(*) FROM gram_df))""",
        "feature_table": f"""SELECT speech_id, block, feature, {_R('v', 'value')} FROM (
            SELECT speech_id, 'function_words' AS block, w AS feature, v FROM fw_values
            UNION ALL SELECT speech_id, 'word_lengths', 'w_len_' || i, v FROM word_fit_curve
            UNION ALL SELECT speech_id, 'sentence_lengths', 's_len_' || i, v FROM sent_fit_curve
            UNION ALL SELECT speech_id, 'pos_tags', gram, v FROM pos_fit_tfidf
            UNION ALL SELECT speech_id, 'stress', gram, v FROM stress_fit_tfidf
            """ + " ".join(f"UNION ALL SELECT speech_id, 'liwc_{m}', gram, v FROM {m}_fit_tfidf WHERE gram IN (SELECT gram FROM {m}_best)"
                           for m in _SELECTED) + ")",
        "feature_columns": """SELECT block, feature, CAST(row_number() OVER (ORDER BY b, place, feature) - 1 AS INTEGER) AS idx FROM (
            SELECT 0 AS b, 'function_words' AS block, w AS feature, place FROM function_words
            UNION ALL SELECT 1, 'word_lengths', 'w_len_' || i, i FROM (SELECT DISTINCT i FROM word_fit_curve)
            UNION ALL SELECT 2, 'sentence_lengths', 's_len_' || i, i FROM (SELECT DISTINCT i FROM sent_fit_curve)
            UNION ALL SELECT 3, 'pos_tags', gram, 0 FROM pos_train_df
            UNION ALL SELECT 4, 'stress', gram, 0 FROM stress_train_df
            """ + " ".join(f"UNION ALL SELECT {5 + i}, 'liwc_{m}', gram, 0 FROM {m}_best" for i, m in enumerate(_SELECTED)) + ")",
        "split_50": """SELECT speech_id, speaker, CASE WHEN row_number() OVER (PARTITION BY speaker
            ORDER BY md5('42:' || speech_id), speech_id) <= 50 THEN 'train' ELSE 'test' END AS side FROM speeches WHERE text IS NOT NULL""",
        "split_stratified": """SELECT speech_id, party AS y, CASE WHEN row_number() OVER (PARTITION BY party ORDER BY md5('42:' || speech_id), speech_id)
            <= round(0.1 * count(*) OVER (PARTITION BY party)) THEN 'test' ELSE 'train' END AS side FROM speeches""",
        "folds": """SELECT speech_id, party AS y, CAST((row_number() OVER (PARTITION BY party ORDER BY md5('42:' || speech_id), speech_id) - 1) % 5
            AS INTEGER) AS fold FROM speeches""",
        "binary_labels": f"SELECT speech_id, task_label, CAST(party = task_label AS INTEGER) AS y_bin FROM speeches, (SELECT unnest([{_list(PARTIES)}]) AS task_label)",
        "confusion": "SELECT run, task_label, method, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL",
        "label_scores": f"SELECT run, task_label, method, label, tp, fp, fn, {_R('f1', 'f1')} FROM scores",
        "f1_binary": f"SELECT run, task_label, method, {_R('f1', 'f1')} FROM f1b",
        "f1_macro_micro": f"""SELECT run, task_label, method, {_R('avg(f1)', 'macro_f1')},
            {_R('2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))', 'micro_f1')} FROM scores GROUP BY ALL""",
        "best_method": "SELECT run, task_label, method, f1 FROM f1s a WHERE f1 = (SELECT max(f1) FROM f1s b WHERE b.task_label = a.task_label)",
        "f1_pooled_cv": f"""SELECT task_label, grid_idx, {_R('2.0 * tp / (2 * tp + wrong)', 'score')} FROM (
            SELECT task_label, grid_idx, count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE truth <> guess) AS wrong FROM (
              SELECT f.task_label, g.grid_idx, truth, CAST(n_chars > mean * g.grid_idx / 4 AS INTEGER) AS guess
              FROM (SELECT *, CAST(sum(n_chars) OVER (PARTITION BY task_label) - sum(n_chars) OVER (PARTITION BY task_label, fold) AS DOUBLE)
                  / (count(n_chars) OVER (PARTITION BY task_label) - count(n_chars) OVER (PARTITION BY task_label, fold)) AS mean FROM (
                SELECT *, (row_number() OVER (PARTITION BY task_label, truth ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold
                FROM (SELECT doc_id, 'quality' AS task_label, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
                JOIN documents USING (doc_id))) f, (SELECT unnest(range(1, 5)) AS grid_idx) g) GROUP BY ALL)""",
        "best_grid": f"""SELECT task_label, grid_idx, {_R('score', 'score')} FROM (
            SELECT *, row_number() OVER (PARTITION BY task_label ORDER BY score DESC, grid_idx) AS r FROM (
              SELECT task_label, grid_idx, 2.0 * tp / (2 * tp + wrong) AS score FROM (
                SELECT task_label, grid_idx, count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE truth <> guess) AS wrong FROM (
                  SELECT task_label, g.grid_idx, truth, CAST(n_chars > 500 * g.grid_idx AS INTEGER) AS guess
                  FROM (SELECT doc_id, 'quality' AS task_label, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
                  JOIN documents USING (doc_id), (SELECT unnest(range(1, 5)) AS grid_idx) g) GROUP BY ALL))) WHERE r = 1""",
        "mcnemar": f"""SELECT run, task_label, baseline, method, yy, yn, ny, nn, least(yn, ny) AS statistic,
            {_R(p_exact, 'p')}, {p_exact} <= 0.05 AS significant FROM ({cells.format(where="WHERE a.method = 'RULE' AND b.method <> 'RULE'")})""",
        "compare_methods": f"""SELECT x.run, x.task_label, x.method, x.baseline, {_R('a.f1', 'score')}, {_R('b.f1', 'baseline_score')},
            {_R('(a.f1 - b.f1) * 100 / nullif(b.f1, 0)', 'delta_pct')}, yn, ny, {_R(p_exact, 'p')}
            FROM ({cells.format(where="WHERE a.method = 'RULE' AND b.method <> 'RULE'")}) x
            JOIN f1s a ON a.task_label = x.task_label AND a.method = x.method
            JOIN f1s b ON b.task_label = x.task_label AND b.method = x.baseline
            WHERE a.f1 = (SELECT max(f1) FROM f1s c WHERE c.task_label = x.task_label AND c.method <> 'RULE')""",
        "outside_model_scores": """SELECT 'MC_lang' AS run, method, 'all' AS label, metric, value FROM model_scores
            UNPIVOT (value FOR metric IN (macro_f1, micro_f1)) WHERE method LIKE 'MODEL%'""",
        "compare_multiclass": f"""SELECT 'MC_lang' AS run, a.method, b.method AS baseline, a.macro_f1, a.micro_f1, b.macro_f1 AS baseline_macro_f1,
            b.micro_f1 AS baseline_micro_f1, {_R('(a.macro_f1 - b.macro_f1) * 100 / nullif(b.macro_f1, 0)', 'delta_macro')},
            {_R('(a.micro_f1 - b.micro_f1) * 100 / nullif(b.micro_f1, 0)', 'delta_micro')}, yy, yn, ny, nn, {_R(p_exact, 'p')}
            FROM (SELECT * FROM model_scores WHERE method NOT LIKE 'MODEL%' QUALIFY macro_f1 = max(macro_f1) OVER ()) a,
              (SELECT * FROM model_scores WHERE method LIKE 'MODEL%' QUALIFY macro_f1 = max(macro_f1) OVER ()) b
            JOIN (SELECT x.method, y.method AS other, count(*) FILTER (WHERE y.ok AND x.ok) AS yy, count(*) FILTER (WHERE y.ok AND NOT x.ok) AS yn,
                count(*) FILTER (WHERE NOT y.ok AND x.ok) AS ny, count(*) FILTER (WHERE NOT y.ok AND NOT x.ok) AS nn
              FROM (SELECT *, y_true = y_pred AS ok FROM model_preds) x JOIN (SELECT *, y_true = y_pred AS ok FROM model_preds) y USING (doc_id)
              GROUP BY ALL) c ON c.method = a.method AND c.other = b.method""",
        "style_indices": f"SELECT speaker, CAST(n_words AS BIGINT) AS n_words, {style_cols} FROM style",
        "style_by_text": f"SELECT speech_id, CAST(n_words AS BIGINT) AS n_words, {style_cols} FROM style_texts",
        "cni_texts_top": f"""SELECT speech_id, {_R('cni', 'cni')}, kind FROM (
            (SELECT speech_id, cni, 'max' AS kind FROM style_texts WHERE cni IS NOT NULL ORDER BY cni DESC, speech_id LIMIT 10)
            UNION ALL (SELECT speech_id, cni, 'min' FROM style_texts WHERE cni IS NOT NULL ORDER BY cni, speech_id LIMIT 10))""",
        "index_by_wing": f"""SELECT s.speaker, s.style, split_part(s.speaker, ' ', 1) AS first_name, {_ENGLISH.format(w='m.label')} AS wing, {_R('s.idx', 'idx')}
            FROM (SELECT speaker, style, idx FROM (FROM style UNPIVOT INCLUDE NULLS (idx FOR style IN (ati, cni, asi, pos_minus_neg, pos_plus_neg)))) s
            LEFT JOIN (SELECT * FROM modal WHERE kind = 'wing') m USING (speaker)""",
        "words_by_wing": rf"""SELECT s.speaker, split_part(s.speaker, ' ', 1) AS first_name, {_ENGLISH.format(w='m.label')} AS wing,
            CAST(n_words AS BIGINT) AS n_words FROM (SELECT speaker, sum(len(regexp_extract_all(text, '\S+'))) AS n_words FROM speeches GROUP BY speaker) s
            LEFT JOIN (SELECT * FROM modal WHERE kind = 'wing') m USING (speaker)""",
        "anova": f"""SELECT task_label, kind, method, k, n, df_between, df_within, {_R('mse', 'mse')}, {_R('f_stat', 'f_stat')},
            {_R(_f_tail('f_stat', 'df_between', 'df_within'), 'p')} FROM aov""",
        "levene": f"""SELECT task_label, kind, method, k, n, {_R('f_stat', 'f_stat')},
            {_R(_f_tail('f_stat', 'df_between', 'df_within'), 'p')} FROM ({_anova('''(SELECT g.task_label, g.kind, g.method, g.grp,
            abs(f1 - median(f1) OVER (PARTITION BY task_label, kind, method, grp)) AS d FROM grouped g)''', 'd')})""",
        "tukey_q": f"""SELECT a.task_label, a.kind, a.method, a.grp AS group_a, b.grp AS group_b, {_R('b.m - a.m', 'mean_diff')},
            {_R('abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n))', 'q')}
            FROM (SELECT task_label, kind, method, grp, avg(f1) AS m, count(*) AS n FROM grouped GROUP BY ALL) a
            JOIN (SELECT task_label, kind, method, grp, avg(f1) AS m, count(*) AS n FROM grouped GROUP BY ALL) b ON a.task_label = b.task_label AND a.kind = b.kind AND a.method = b.method AND a.grp < b.grp
            JOIN aov ON aov.task_label = a.task_label AND aov.kind = a.kind AND aov.method = a.method""",
        "tukey_hsd": f"""SELECT task_label, kind, method, group_a, group_b, {_R('mean_diff', 'mean_diff')}, {_R('q', 'q')}, k, df AS df_within,
            {_R('p', 'p')}, p < 0.05 AS reject FROM ({_range_tail()})""",
        "spearman": f"""SELECT task_label, method, style, n, {_R('r', 'r')}, {_R(_f_tail('(r * r * (n - 2) / (1 - r * r))', '1', '(n - 2)'), 'p')} FROM (
            SELECT task_label, method, style, count(*) AS n, corr(rx, ry) AS r FROM ({ranks}) GROUP BY ALL)""",
        "bestfit": f"""SELECT task_label, method, style, CAST(regr_count(f1, idx) AS BIGINT) AS n, {_R('regr_slope(f1, idx)', 'slope')},
            {_R('regr_intercept(f1, idx)', 'intercept')}, {_R('regr_r2(f1, idx)', 'r2')} FROM indexed GROUP BY ALL""",
        "box_summary": f"""SELECT task_label, kind, method, grp, {_R('q1', 'q1')}, {_R('med', 'median')}, {_R('q3', 'q3')}, count(*) AS n,
            {_R('min(f1) FILTER (WHERE f1 >= q1 - 1.5 * (q3 - q1) AND f1 <= q3 + 1.5 * (q3 - q1))', 'whisker_low')},
            {_R('max(f1) FILTER (WHERE f1 >= q1 - 1.5 * (q3 - q1) AND f1 <= q3 + 1.5 * (q3 - q1))', 'whisker_high')},
            count(*) FILTER (WHERE NOT (f1 >= q1 - 1.5 * (q3 - q1) AND f1 <= q3 + 1.5 * (q3 - q1))) AS n_outliers
            FROM grouped JOIN (SELECT task_label, kind, method, grp, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS med, quantile_cont(f1, 0.75) AS q3
              FROM grouped GROUP BY ALL) USING (task_label, kind, method, grp) GROUP BY task_label, kind, method, grp, q1, med, q3""",
        "todo_methods": f"""SELECT set_no, method FROM (VALUES {sets}) AS t(set_no, method) WHERE method NOT IN (
            SELECT CASE method WHEN 'LENGTH' THEN 'BaseFeatures' WHEN 'RULE' THEN 'ALL' ELSE 'ALL - POS' END FROM f1b)""",
        "results_csv": "SELECT method, 'C=' || length(method) AS params, CAST(length(method) AS INTEGER) AS n_features, label, value FROM (SELECT method, task_label AS label, round(f1, 3) AS value FROM f1b)",
        "predictions_store": "SELECT task_label, method, count(*) AS n, count(*) FILTER (WHERE y_true = y_pred) AS n_correct FROM preds GROUP BY ALL",
    }
