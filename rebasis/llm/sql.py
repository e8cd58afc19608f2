"""SQL twins for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from rebasis.llm import decontaminate, licenses, mixing, quality_rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _mixing(spec: mixing.Mix = mixing.Mix()) -> str:
    def h(tag: str, *parts: str) -> str:
        text = " || ':' || ".join([f"'{spec.seed}:{tag}'", *(f"coalesce(({p})::varchar, '')" for p in parts)])
        return f"('0x' || substr(md5({text}), 1, 15))::bigint"

    rounds = []
    for r in range(mixing.ROUNDS):
        rounds.append(f"""
        o{r} as (select *, ({h('key', 'source_no', 'epoch', str(r))} % full_blocks + full_blocks - x) % full_blocks as other
                 from {'start_places' if r == 0 else f'x{r - 1}'}),
        x{r} as (select source_no, epoch, full_blocks, take,
                 case when {h('bit', 'source_no', 'epoch', str(r), 'greatest(x, other)')} % 2 = 1 then other else x end as x
                 from o{r})""")
    top, b = float(mixing.TOP), spec.block
    weight = "case " + " ".join(
        f"when source_no % {len(spec.weights)} = {i} then {float(w)}" for i, w in enumerate(spec.weights)) + " end"
    return rf"""
    with recursive sized as (select doc_id, source, len({WORDS})::bigint as size from documents),
    sums as (select source, sum(size)::bigint as source_size from sized group by source),
    ranked as (select *, row_number() over (order by source asc nulls last) - 1 as source_no from sums),
    weighed as (select *, {weight}::double as weight from ranked),
    levels as (select *, (sum(source_size) over () * {spec.share} - coalesce(sum(source_size * {spec.limit}) over (
            order by source_size * {spec.limit} / weight, source_no rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by source_size * {spec.limit} / weight, source_no
            rows between current row and unbounded following) as level from weighed),
    level as (select arg_min(level, (source_size * {spec.limit} / weight, source_no)) as level from levels
        where source_size * {spec.limit} / weight > level),
    targets as (select source, source_no, source_size,
        least(source_size * {spec.limit}, coalesce((select level from level) * weight, source_size * {spec.limit}))::double
        as target from weighed),
    plan0 as (select *, least(floor(target + 0.5), floor(source_size * {spec.limit}))::bigint as words,
        source_size // {b} as full_blocks, (source_size + {b - 1}) // {b} as blocks from targets where source_size > 0),
    plan1 as (select *, (words // source_size) * blocks + ((words % source_size) + {b - 1}) // {b} as slots from plan0),
    plan as (select *, sum(slots) over (order by source_no)::bigint as hi from plan1),
    total as (select sum(slots)::bigint as n from plan),
    draws as (select id // {spec.shard} as shard,
        least(floor({h('draw', 'id')} / {top} * (select n from total))::bigint, (select n from total) - 1) as u
        from (select unnest(range((select n from total))) as id)),
    counts as (select shard, source_no, count(*) as n from draws join plan on u >= hi - slots and u < hi group by all),
    drawn as (select source_no, sum(n)::bigint as drawn from counts group by source_no),
    sides0 as (select p.source_no, coalesce(drawn, 0) as drawn, greatest(coalesce(drawn, 0) - slots, 0) as over_n,
        greatest(slots - coalesce(drawn, 0), 0) as short_n from plan p left join drawn d on p.source_no = d.source_no),
    sides as (select *, sum(over_n) over (order by source_no) - over_n as over_from,
        sum(short_n) over (order by source_no) - short_n as short_from from sides0),
    places as (select c.source_no, drawn, over_n, over_from, unnest(range(ends - n, ends)) as i
        from (select *, (sum(n) over (partition by source_no order by shard))::bigint as ends from counts) c
        join sides s on c.source_no = s.source_no),
    given as (select *, ((i * over_n) // drawn)::bigint as given, (((i + 1) * over_n) // drawn)::bigint as given_next from places),
    wanted as (select source_no, drawn - short_from as shift, unnest(range(short_from::bigint, (short_from + short_n)::bigint)) as g
        from sides),
    slots as (select source_no, i - given as k from given where given_next = given
        union all select w.source_no, (w.g + w.shift)::bigint from given join wanted w on given.given + over_from = w.g
        where given_next > given),
    ordered as (select s.source_no, k // blocks as epoch, k % blocks as place, full_blocks, source_size, words
        from slots s join plan p on s.source_no = p.source_no),
    cut as (select *, least(case when place < full_blocks then {b} else source_size - full_blocks * {b} end,
        words - (epoch * source_size + least(place * {b}, source_size))) as take from ordered),
    start_places as (select source_no, epoch, full_blocks, take, place as x from cut where place < full_blocks),
    {','.join(rounds)},
    taken_blocks as (select source_no, x as block, take from x{mixing.ROUNDS - 1}
        union all select source_no, full_blocks, take from cut where place >= full_blocks),
    placed as (select doc_id, size, source_no, source_size, target,
        sum(size) over (partition by source_no order by {h('order', 'doc_id')}, doc_id nulls first, size, rn
            rows unbounded preceding)::bigint - size as start, rn
        from (select *, row_number() over () as rn from sized) s join targets t on s.source is not distinct from t.source),
    pieces as (select *, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) as block from placed where size > 0),
    took as (select rn, sum(greatest(least(start + size, p.block * {b} + take) - greatest(start, p.block * {b}), 0)) as taken
        from pieces p join taken_blocks t on p.source_no = t.source_no and p.block = t.block group by rn)
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
    from placed left join took on placed.rn = took.rn
    """


MIXING = _mixing()

_W = quality_rules.WINDOW

QUALITY_RULES = rf"""
with docs as (select row_number() over () as rn, doc_id, source, coalesce(text, '') as text from documents),
worded as (select *, {WORDS} as w, string_split(text, chr(10)) as raw from docs),
lines as (select rn, source, line, l, len(l) as n from (
    select rn, source, unnest(raw) as line from worded), lateral (select regexp_extract_all(line, '[^\x20\x09-\x0D]+') as l)
    where len(l) > 0),
dups as (select rn, count(*) - count(distinct line) as n_dup_lines from lines group by rn),
places as (select rn, w, unnest(range(1, len(w) - {_W - 2})) as i from worded where len(w) >= {_W}),
grams as (select rn, i, array_to_string(w[i:i + {_W - 1}], ' ') as g from places),
twice as (select rn, i from (select *, count(*) over (partition by rn, g) as c from grams) where c > 1),
repeats as (select rn, count(distinct p) as n_repeat_words from (
    select rn, unnest(range(i, i + {_W})) as p from twice) group by rn),
longest as (select rn, arg_min(i, (-length(x), i)) as pos from (
    select rn, unnest(w) as x, generate_subscripts(w, 1) as i from worded) group by rn),
anchored as (select worded.rn, source, array_to_string(w[pos:pos + {_W - 1}], ' ') as anchor
    from worded join longest on worded.rn = longest.rn),
hosts as (select source, count(distinct anchor) as documents from anchored group by source),
shared as (select a.source, lower(array_to_string(l, ' ')) as line, count(distinct anchor) as n
    from lines join anchored a on a.rn = lines.rn group by all),
bad as (select s.source, s.line from shared s join hosts h on s.source is not distinct from h.source
    where n > 20 and n > documents * 0.01),
removed as (select rn, sum(n)::bigint as n from lines join bad on lines.source is not distinct from bad.source
    and lower(array_to_string(l, ' ')) = bad.line group by rn),
signals as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(removed.n, 0)::bigint as n_removed_words
    from worded left join dups on worded.rn = dups.rn left join repeats on worded.rn = repeats.rn
    left join removed on worded.rn = removed.rn)
select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > 20 * n_words) and n_removed_words <= 0.8 * n_words as kept
from signals
"""


def _shingles(table: str, key: str) -> str:
    n = decontaminate.SHINGLE
    return rf"""select distinct {key}, case when len(w) < {n} then array_to_string(w, ' ')
        else array_to_string(w[i:i + {n - 1}], ' ') end as s
    from (select {key}, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) as i from (
        select {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w
        from {table}) where len(w) > 0)"""


DECONTAMINATION = rf"""
with d as ({_shingles('(select row_number() over () as rn, * from documents)', 'rn, doc_id')}),
b as ({_shingles('benchmark', 'item_id')}),
sizes as (select item_id, count(*) as n_shingles from b group by item_id),
shared as (select d.rn, d.doc_id, b.item_id, count(*) as n_shared from d join b on d.s = b.s group by all)
select doc_id, item_id, max(n_shared)::bigint as n_shared, n_shingles::bigint as n_shingles
from shared join sizes using (item_id) where n_shared >= ceil(n_shingles * {decontaminate.THRESHOLD} - 1e-9)
group by doc_id, item_id, n_shingles
"""

_TEMPLATES = ", ".join(
    f"({i}, '{name}', '{notice}')" for i, (name, notice) in enumerate(licenses.TEMPLATES))


def _terms(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


LICENSES = rf"""
with rows_ as (select doc_id, coalesce(text, '') as text, source || '/' ||
    regexp_replace(substr(doc_id::varchar, 1, length(doc_id::varchar) - 1), '(.)', '\1/', 'g') || doc_id || '.txt' as path from documents),
n as (select count(*) as n from rows_),
df as (select term, count(*) as df from (select unnest(list_distinct({_terms('text')})) as term from rows_) group by term),
templates as (select * from (values {_TEMPLATES}) t(template, name, notice)),
bag_t as (select template, name, term, count(*) as tf from (
    select template, name, unnest({_terms('notice')}) as term from templates) group by all),
raw_t as (select template, name, bag_t.term, tf * (ln((1.0 + (select n from n)) / (1 + coalesce(df, 0))) + 1) as w
    from bag_t left join df on bag_t.term = df.term),
vec_t as (select *, w / sqrt(sum(w * w) over (partition by template)) as u from raw_t),
lines as (select path, n_terms, array_to_string(l, ' ') as line, len(l) as n_line from (
    select path, len({_terms('text')}) as n_terms, unnest(string_split(text, chr(10))) as one from rows_),
    lateral (select {_terms('one')} as l) where len(l) > 0),
wordings as (select distinct line from lines),
bag_l as (select line, term, count(*) as tf from (select line, unnest(string_split(line, ' ')) as term from wordings) group by all),
raw_l as (select line, bag_l.term, tf * (ln((1.0 + (select n from n)) / (1 + coalesce(df, 0))) + 1) as w
    from bag_l left join df on bag_l.term = df.term),
vec_l as (select *, w / sqrt(sum(w * w) over (partition by line)) as u from raw_l),
cosines as (select line, template, name, sum(a.u * b.u) as cosine from vec_l a join vec_t b on a.term = b.term group by all),
best as (select line, max(round(cosine, 6)) as cosine, arg_min(name, (-round(cosine, 6), name)) as name from cosines
    where cosine >= {licenses.THRESHOLD} group by line),
own as (select path, max(cosine) as own_score, arg_min(name, (-cosine, name)) as own_license,
    sum(n_line) >= {licenses.FILE_SHARE} * max(n_terms) as is_license_file
    from lines join best on lines.line = best.line group by path),
holders as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, arg_min(own_license, (-own_score, path)) as held
    from own where is_license_file group by 1),
dirs as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as of from rows_ where path is not null),
up as (select distinct of, array_to_string(string_split(of, '/')[1:k], '/') as dir from (
    select of, unnest(range(0, len(string_split(of, '/')) + 1)) as k from dirs)),
nearest as (select of, arg_max(up.dir, length(up.dir)) as inherited_from, arg_max(held, length(up.dir)) as held
    from up join holders on up.dir = holders.dir group by of)
select doc_id, r.path, own_license, own_score, coalesce(is_license_file, false) as is_license_file,
    coalesce(own_license, held) as license, case when own_license is null then inherited_from end as inherited_from
from rows_ r left join own on r.path = own.path
left join nearest on regexp_extract(r.path, '^(.*)/[^/]*$', 1) = nearest.of
"""


def _va_clusters(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256) -> str:
    """Lloyd rounds over exploded integer vectors; every distance measured, no approximation."""
    parts = [
        f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim}
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"e AS (SELECT rid, unnest(range({dim})) AS dim, unnest(q) AS val FROM v)",
        f"""s0 AS (
  SELECT q, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, array_to_string(q, ',') AS t
  FROM v ORDER BY h, t LIMIT {k})""",
        "n0 AS (SELECT row_number() OVER (ORDER BY h, t) - 1 AS cid, q FROM s0)",
        f"c0 AS (SELECT cid, unnest(range({dim})) AS dim, unnest(q) AS val FROM n0)",
    ]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (
  SELECT e.rid, c.cid, sum((e.val - c.val) * (e.val - c.val)) AS dist FROM e JOIN c{r} c USING (dim) GROUP BY e.rid, c.cid)""")
        parts.append(f"""a{r} AS (
  SELECT rid, cid, dist FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, cid) AS rn FROM d{r}) WHERE rn = 1)""")
        if r < rounds:
            parts.append(f"""g{r} AS (SELECT a.cid, e.dim, sum(e.val) AS s, count(*) AS n FROM a{r} a JOIN e USING (rid) GROUP BY a.cid, e.dim)""")
            parts.append(f"""c{r + 1} AS (
  SELECT cid, dim, (s - ((s % n) + n) % n) // n AS val FROM g{r}
  UNION ALL SELECT cid, dim, val FROM c{r} WHERE cid NOT IN (SELECT cid FROM a{r}))""")
    parts.append(f"""h AS (SELECT cid, sha256(string_agg(val::VARCHAR, ',' ORDER BY dim)) AS sha FROM c{rounds} GROUP BY cid)""")
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT v.vec_id, a.cid::INTEGER AS cluster, a.dist::BIGINT AS distance,
       (sum(a.dist) OVER (PARTITION BY a.cid))::BIGINT AS cluster_inertia, (sum(a.dist) OVER ())::BIGINT AS inertia,
       h.sha AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN h USING (cid)"""


VA_CLUSTERS = _va_clusters()


def _variants() -> str:
    """Words by SQL: crc32 spelled out over UTF-8 bytes, all pairs of near length compared."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n::BIGINT)) AS tbl),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k,
         translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{upper}', '{lower}') AS low
  FROM documents),
b AS (
  SELECT low, flatten(list_transform(string_split(k || ':' || low, ''), lambda ch: CASE
    WHEN unicode(ch) < 128 THEN [unicode(ch)]
    WHEN unicode(ch) < 2048 THEN [192 + unicode(ch) // 64, 128 + unicode(ch) % 64]
    WHEN unicode(ch) < 65536 THEN [224 + unicode(ch) // 4096, 128 + (unicode(ch) // 64) % 64, 128 + unicode(ch) % 64]
    ELSE [240 + unicode(ch) // 262144, 128 + (unicode(ch) // 4096) % 64, 128 + (unicode(ch) // 64) % 64,
          128 + unicode(ch) % 64] END)) AS bytes
  FROM r),
h AS (
  SELECT low, xor(list_reduce(bytes, lambda c, x: xor(tbl[xor(c, x) % 256 + 1], c // 256), 4294967295::BIGINT),
                  4294967295) AS h
  FROM b, t),
w AS (
  SELECT CASE WHEN h % 31 = 0
              THEN substr(low, 1, (h % length(low))::BIGINT) || substr(low, (h % length(low))::BIGINT + 2)
              ELSE low END AS word
  FROM h),
words AS (
  SELECT word, count(*) AS n,
         translate(word, array_to_string(list_transform(range(192, 256), lambda i: chr(i::INTEGER)), ''),
                         array_to_string(list_transform(range(1, 65), lambda i: chr(i::INTEGER)), '')) AS one_byte
  FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
near AS (
  SELECT a.word, c.word AS other, c.n AS other_n
  FROM words a JOIN words c
    ON abs(length(a.word) - length(c.word)) <= 1 AND a.word <> c.word AND levenshtein(a.one_byte, c.one_byte) = 1),
best AS (
  SELECT word, other, other_n, n_near FROM (
    SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS rn FROM near) WHERE rn = 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS cur, 0 AS depth FROM forms
  UNION ALL
  SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN forms f ON f.word = c.cur WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(cur, depth) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN roots r USING (word)"""


VARIANTS = _variants()
