"""The queries on tokens and sequences in DuckDB's SQL."""

from __future__ import annotations

from bhashaloom.plans.line_sql import full, pieces

_WORD_IDS = f"list_transform({pieces('line')}, lambda w: ((('0x' || substr(md5(w), 1, 8))::BIGINT) % 50304)::INTEGER)"
_PREPARED = f"prepared AS (SELECT line_id, lang, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, line FROM prepared_lines WHERE is_test IS NOT NULL AND {full('line')})"
_HASH = "('0x' || substr(md5('42:' || {}), 1, 8))::BIGINT"
_SINGLE = """numbered AS (SELECT split_name, lang, seq_id, tokens, row_number() OVER (PARTITION BY split_name, lang ORDER BY seq_id) - 1 AS n FROM packed_seqs),
single AS (SELECT split_name, lang, n // 16 AS batch, n % 16 AS slot, seq_id, tokens FROM numbered)"""
_TRAIN = "train AS (SELECT * FROM packed_seqs WHERE split_name = 'train')"

SQL = {
    "token_lines_codepoint": f"WITH {_PREPARED} SELECT line_id, list_transform(string_split(line, ''), lambda c: unicode(c)) AS tokens FROM prepared",
    "token_lines_words": f"WITH {_PREPARED} SELECT line_id, {_WORD_IDS} AS tokens FROM prepared",
    "pack_sequences": f"""WITH {_PREPARED}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY lang, split ORDER BY line_id) - 1) // 500 AS chunk FROM prepared),
gathered AS (SELECT lang, split, chunk, flatten(list({_WORD_IDS} ORDER BY line_id)) AS every FROM numbered GROUP BY lang, split, chunk),
seqs AS (SELECT *, unnest(range(0, len(every) // 128)) AS seq FROM gathered)
SELECT lang, split, chunk, seq, list_slice(every, seq * 128 + 1, seq * 128 + 128) AS tokens FROM seqs""",
    "shift_windows": "SELECT seq_id, list_slice(tokens, 1, len(tokens) - 1) AS x, list_slice(tokens, 2, len(tokens)) AS y FROM packed_seqs",
    "shift_windows_repeating": "SELECT seq_id, list_append(list_slice(tokens, 2, len(tokens)), tokens[-1]) AS y FROM packed_seqs",
    "context_crop": "SELECT seq_id, list_slice(tokens, greatest(len(tokens) - 255, 1), len(tokens)) AS context FROM packed_seqs",
    "shuffle_sequences": f"WITH {_TRAIN} SELECT lang, seq_id, tokens, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || seq_id), seq_id) AS pos FROM train",
    "buffer_shuffle": f"""WITH {_TRAIN}, numbered AS (SELECT lang, seq_id, tokens, (row_number() OVER (PARTITION BY lang ORDER BY seq_id) - 1) // 100 AS buffer FROM train)
SELECT lang, seq_id, tokens, buffer, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || buffer), md5('42:' || seq_id), seq_id) AS pos FROM numbered""",
    "language_weights": "SELECT split_name, lang, n AS n_sequences, round(n / sum(n) OVER (PARTITION BY split_name), 9) AS weight FROM (SELECT split_name, lang, count(*) AS n FROM packed_seqs GROUP BY ALL)",
    "batch_allocation": f"""WITH {_TRAIN}, w AS (SELECT lang, round(count(*) / sum(count(*)) OVER (), 9) AS weight FROM train GROUP BY lang),
s AS (SELECT lang, floor(weight * 16 + 1e-9)::BIGINT AS slots, row_number() OVER (ORDER BY weight DESC, lang) AS place FROM w)
SELECT lang, (slots + CASE WHEN place = 1 THEN 16 - (SELECT sum(slots) FROM s) ELSE 0 END)::BIGINT AS slots FROM s""",
    "mixed_batch": f"""WITH {_TRAIN}, counts AS (SELECT lang, count(*) AS n FROM train WHERE lang IS NOT NULL GROUP BY lang),
bands AS (SELECT lang, n, sum(n) OVER (ORDER BY lang) AS hi, sum(n) OVER (ORDER BY lang) - n AS lo FROM counts), total AS (SELECT sum(n)::BIGINT AS t FROM counts),
slots AS (SELECT draw, floor(({_HASH.format('draw')}) / 4294967296.0 * t)::BIGINT AS spot FROM (SELECT t, unnest(range(0, t // 16 * 16)) AS draw FROM total)),
taken AS (SELECT draw, lang, n, row_number() OVER (PARTITION BY lang ORDER BY draw) AS turn FROM slots JOIN bands ON spot >= lo AND spot < hi),
numbered AS (SELECT lang, seq_id, tokens, row_number() OVER (PARTITION BY lang ORDER BY seq_id) AS nth FROM train WHERE lang IS NOT NULL)
SELECT draw // 16 AS batch, draw % 16 AS slot, t.lang, seq_id, tokens FROM taken t JOIN numbered b ON t.lang = b.lang AND (turn - 1) % n + 1 = nth""",
    "language_batch": f"WITH {_SINGLE} SELECT * FROM single",
    "padded_batch": f"""WITH {_SINGLE}, sizes AS (SELECT split_name, lang, batch, count(*) AS have FROM single GROUP BY ALL HAVING count(*) < 16),
holes AS (SELECT *, unnest(range(have, 16)) AS hole FROM sizes),
picked AS (SELECT *, ({_HASH.format("split_name || ':' || lang || ':' || batch || ':' || hole")}) % have AS from_slot FROM holes)
SELECT * FROM single UNION ALL SELECT p.split_name, p.lang, p.batch, p.hole, s.seq_id, s.tokens FROM picked p JOIN single s ON p.split_name = s.split_name AND p.lang = s.lang AND p.batch = s.batch AND p.from_slot = s.slot""",
    "random_windows": f"""WITH {_TRAIN}, whole AS (SELECT lang, flatten(list(tokens ORDER BY seq_id)) AS every FROM train WHERE lang IS NOT NULL GROUP BY lang),
draws AS (SELECT lang, every, unnest(range(0, 100)) AS draw FROM whole WHERE len(every) > 512),
placed AS (SELECT *, ({_HASH.format("lang || ':' || draw")}) % (len(every) - 512) AS start FROM draws)
SELECT lang, draw, start, list_slice(every, start + 1, start + 512) AS x, list_slice(every, start + 2, start + 513) AS y FROM placed""",
    "dataset_counts": "SELECT split_name, lang, count(*) AS n_sequences, sum(len(tokens))::BIGINT AS n_tokens, count(DISTINCT file_name) AS n_files FROM packed_seqs GROUP BY split_name, lang",
    "fertility": f"WITH {_PREPARED} SELECT lang, count(*) AS n_lines, round(avg(len({pieces('line')}) / length(line)), 6) AS fertility FROM prepared GROUP BY lang",
    "shard_counts": "SELECT file_name, split_part(file_name, '_', 1) AS lang, n_bytes // 2048 AS n_sequences, n_bytes % 2048 AS rest FROM (SELECT DISTINCT file_name, n_bytes FROM bin_files)",
    "bin_roundtrip": "SELECT lang, count(*) AS n_sequences, sum(list_sum(tokens))::BIGINT AS token_sum FROM packed_seqs WHERE lang IS NOT NULL GROUP BY lang",
    "bin_roundtrip_splits": "SELECT split_name, lang, count(*) AS n_sequences, sum(list_sum(tokens))::BIGINT AS token_sum FROM packed_seqs GROUP BY split_name, lang",
}
