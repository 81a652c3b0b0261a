"""The domain tables and shared steps as SQL, to check the plans against another engine."""

from __future__ import annotations

PARTS: dict[str, str] = {
    "ev": "SELECT event_id, user_id AS video_id, event_type, value, CAST((date_diff('second', TIMESTAMP '2024-01-01', ts) // 10800) * 10 AS BIGINT) AS frame FROM events",
    "vid": "SELECT video_id, 'cam_id' || lpad(CAST(video_id % 40 AS VARCHAR), 6, '0') || '_v' || CAST(video_id AS VARCHAR) AS video_name, lpad(CAST(video_id % 40 AS VARCHAR), 6, '0') AS child_id, ((video_id % 40) * 3 + 36) / 12 AS age_at_recording, max(frame) AS max_frame FROM ev GROUP BY video_id",
    "det": """SELECT CASE WHEN event_type = 'purchase' THEN 'face' ELSE 'person' END AS kind, event_id AS detection_id, video_id, frame, least(value / 100, 1.0) AS conf,
        CAST(event_id * 37 % 1800 AS DOUBLE) AS x1, CAST(event_id * 53 % 900 AS DOUBLE) AS y1, CAST(event_id * 37 % 1800 + 10 + event_id * 7 % 400 AS DOUBLE) AS x2,
        CAST(event_id * 53 % 900 + 10 + event_id * 11 % 380 AS DOUBLE) AS y2, CAST(event_id % 2 AS INTEGER) AS age_class FROM ev WHERE event_type IN ('purchase', 'signup')""",
    "book": "SELECT video_id, frame, x1 + o AS x1, y1 + o AS y1, x2 + o AS x2, y2 + o AS y2 FROM (SELECT *, CASE WHEN detection_id % 3 = 0 THEN 0.0 ELSE 30.0 END AS o FROM det WHERE detection_id % 3 < 2)",
    "aud": "SELECT video_id, frame, CAST(event_type = 'click' AS INTEGER) AS has_kchi, CAST(event_type = 'view' AS INTEGER) AS has_cds, CAST(event_type = 'error' AS INTEGER) AS has_ohs FROM ev WHERE event_type IN ('click', 'view', 'error')",
    "grid": "SELECT video_id, unnest(range(0, greatest(coalesce(max_frame, 0), 0) + 1, 10)) AS frame FROM vid",
    "kept": "SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM book b WHERE b.video_id = d.video_id AND b.frame = d.frame AND d.x1 >= b.x1 AND d.y1 >= b.y1 AND d.x2 <= b.x2 AND d.y2 <= b.y2)",
    "near": """SELECT *, CASE WHEN abs(shape - usual) > 1 THEN 1.0 WHEN area >= close THEN 1.0 WHEN area <= far THEN 0.0 ELSE (ln(area) - ln(far)) / (ln(close) - ln(far)) END AS proximity
        FROM (SELECT *, (x2 - x1) * (y2 - y1) AS area, CASE WHEN y2 = y1 THEN 0 ELSE (x2 - x1) / (y2 - y1) END AS shape, CASE age_class WHEN 0 THEN 458185 ELSE 442980 END AS close, CASE age_class WHEN 0 THEN 308 ELSE 208 END AS far,
        CASE age_class WHEN 0 THEN 0.965166908563135 ELSE 0.6461352657004831 END AS usual FROM kept WHERE kind = 'face')""",
    "face": "SELECT video_id, frame, max(proximity) AS proximity, max(conf) AS face_conf FROM near WHERE frame % 10 = 0 GROUP BY ALL",
    "person": "SELECT video_id, frame, max(conf) AS person_conf FROM kept WHERE kind = 'person' AND frame % 10 = 0 GROUP BY ALL",
    "shown": "SELECT DISTINCT video_id, frame, 1 AS has_book FROM book WHERE frame % 10 = 0",
    "hull": "SELECT video_id, frame, min(x1) AS last_x1, min(y1) AS last_y1, max(x2) AS last_x2, max(y2) AS last_y2 FROM det GROUP BY ALL",
    "speech": "SELECT video_id, frame, max(has_kchi) AS has_kchi, max(has_cds) AS has_cds, max(has_ohs) AS has_ohs FROM aud GROUP BY ALL",
    "fr": """SELECT g.video_id, g.frame, coalesce(person_conf, 0) AS person_conf, coalesce(face_conf, 0) AS face_conf, proximity, coalesce(has_book, 0) AS has_book, coalesce(has_kchi, 0) AS has_kchi, coalesce(has_cds, 0) AS has_cds,
        coalesce(has_ohs, 0) AS has_ohs, coalesce(last_x1, -1) AS last_x1, coalesce(last_y1, -1) AS last_y1, coalesce(last_x2, -1) AS last_x2, coalesce(last_y2, -1) AS last_y2, greatest(coalesce(person_conf, 0), coalesce(face_conf, 0)) AS presence_conf
        FROM grid g LEFT JOIN face USING (video_id, frame) LEFT JOIN person USING (video_id, frame) LEFT JOIN shown USING (video_id, frame) LEFT JOIN hull USING (video_id, frame) LEFT JOIN speech USING (video_id, frame)""",
    "feat": """SELECT *, avg(presence_conf) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS presence_score, max(presence_conf) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) >= 0.4 AS seen_recently,
        count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND sum(has_cds) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 0.8 * 3 AS sustained_kcds,
        count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND sum(has_ohs) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 0.03 * 3 AS sustained_ohs
        FROM fr WINDOW w AS (PARTITION BY video_id ORDER BY frame)""",
    "talk": "SELECT video_id, frame, 'kchi' AS type, 0 AS rank FROM fr WHERE has_kchi = 1 UNION ALL SELECT video_id, frame, 'cds', 1 FROM fr WHERE has_cds = 1",
    "isl": """SELECT video_id, type, rank, min(frame) AS a, max(frame) AS b FROM (SELECT *, frame - 10 * row_number() OVER (PARTITION BY video_id, type ORDER BY frame) AS grp FROM talk) GROUP BY video_id, type, rank, grp""",
    "seq": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, rank, type, b) AS n FROM isl",
    "fold": """SELECT video_id, n, a AS s, b AS e, type = 'kchi' AS k, type = 'cds' AS c, 1 AS bout FROM seq WHERE n = 1
        UNION ALL SELECT q.video_id, q.n, CASE WHEN j THEN f.s ELSE q.a END, q.b, CASE WHEN j THEN f.k OR q.type = 'kchi' ELSE q.type = 'kchi' END, CASE WHEN j THEN f.c OR q.type = 'cds' ELSE q.type = 'cds' END, f.bout + CASE WHEN j THEN 0 ELSE 1 END
        FROM fold f JOIN seq q ON q.video_id = f.video_id AND q.n = f.n + 1, LATERAL (SELECT q.a - f.e <= CASE WHEN CASE WHEN q.type = 'kchi' THEN f.k ELSE f.c END THEN 45 ELSE 240 END AS j)""",
    "bouts": "SELECT video_id, min(s) AS a, max_by(e, n) AS b FROM fold GROUP BY video_id, bout HAVING bool_or(k) AND bool_or(c)",
    "marked": "SELECT f.*, (f.has_kchi = 1 OR f.has_cds = 1) AND EXISTS (SELECT 1 FROM bouts t WHERE t.video_id = f.video_id AND f.frame BETWEEN t.a AND t.b) AS in_bout FROM feat f",
    "st": """SELECT *, CASE WHEN in_bout OR (sustained_kcds AND presence_score >= 0.18) OR coalesce(presence_conf >= 0.4 AND proximity >= 0.8, false) THEN 1
        WHEN seen_recently OR (sustained_ohs AND presence_score >= 0.18) THEN 2 ELSE 3 END AS state, coalesce(proximity >= 0.8, false) AS rule_proximity FROM marked""",
    "rle": """SELECT video_id, CASE state WHEN 1 THEN 'Interacting' WHEN 2 THEN 'Available' ELSE 'Alone' END AS t, min(frame) AS a, max(frame) AS b FROM (SELECT video_id, frame, state, row_number() OVER (PARTITION BY video_id ORDER BY frame) - row_number() OVER (PARTITION BY video_id, state ORDER BY frame) AS grp FROM st)
        GROUP BY video_id, state, grp HAVING max(frame) - min(frame) >= CASE state WHEN 1 THEN 0 WHEN 2 THEN 9 ELSE 30 END""",
    "mrg": """SELECT video_id, t, min(a) AS a, max_by(b, a) AS b FROM (SELECT *, sum(ch) OVER (PARTITION BY video_id ORDER BY a) AS run FROM (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY video_id ORDER BY a) THEN 0 ELSE 1 END AS ch FROM rle)) GROUP BY video_id, t, run""",
    "gap": "SELECT *, lead(a) OVER (PARTITION BY video_id ORDER BY a) AS na FROM mrg",
    "fil": """SELECT video_id, t, a, CASE WHEN (na - b) / 30 > 0 AND na / 30 - b / 30 <= 0.1 THEN na - 1 ELSE b END AS b, a / 30 AS s, CASE WHEN na - b > 0 AND na / 30 - b / 30 <= 0.1 THEN na / 30 ELSE b / 30 END AS e FROM gap
        UNION ALL SELECT video_id, 'Alone', b + 1, na - 1, b / 30, na / 30 FROM gap WHERE na / 30 - b / 30 > 0.1""",
    "seg": """SELECT video_id, t AS interaction_type, min(a) AS segment_start, max_by(b, a) AS segment_end, min(s) AS start_sec, max_by(e, a) AS end_sec, max_by(e, a) - min(s) AS duration_sec FROM (SELECT *, sum(ch) OVER (PARTITION BY video_id ORDER BY a) AS run FROM
        (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY video_id ORDER BY a) THEN 0 ELSE 1 END AS ch FROM fil)) GROUP BY video_id, t, run""",
    "snip": "SELECT conv_id AS video_id, turn, CAST(turn * 5 AS DOUBLE) AS s, turn * 5 + length(text) % 12 + 1.0::DOUBLE AS e, CASE role WHEN 'user' THEN 'KCHI' WHEN 'assistant' THEN 'KCDS' ELSE 'OHS' END AS speaker FROM conversations",
    "lastt": "SELECT conv_id AS video_id, CAST(max(turn) * 5 + 9 AS DOUBLE) AS last FROM conversations GROUP BY 1",
    "chat": "SELECT * FROM (SELECT video_id, 'Interacting' AS t, 0.0::DOUBLE AS s, 8.0::DOUBLE AS e FROM lastt UNION ALL SELECT video_id, 'Available', 8.0, 17.0 FROM lastt UNION ALL SELECT video_id, 'Interacting', 17.0, last FROM lastt) WHERE e > s",
    "ov": "SELECT c.video_id, c.t, c.s, c.e, p.s AS ps, p.e AS pe, p.speaker, greatest(c.s, p.s) AS f, least(c.e, p.e) AS g FROM chat c JOIN snip p ON p.video_id = c.video_id AND p.s < c.e AND p.e > c.s",
    "ovk": "SELECT *, unnest(CASE speaker WHEN 'KCDS' THEN ['TOTAL', 'KCDS_ONLY'] WHEN 'OHS' THEN ['TOTAL', 'OHS_ONLY'] ELSE [] END) AS k FROM ov",
    "cover": "SELECT video_id, t, s, e, k, g - greatest(f, coalesce(max(g) OVER (PARTITION BY video_id, t, s, e, k ORDER BY f, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f)) AS part FROM ovk",
    "expo": """SELECT c.video_id, c.t, c.s, c.e, k.k AS exposure_type, coalesce((SELECT sum(greatest(part, 0)) FROM cover v WHERE v.video_id = c.video_id AND v.s = c.s AND v.t = c.t AND v.e = c.e AND v.k = k.k), 0) AS speech_sec, c.e - c.s AS duration_sec
        FROM (SELECT DISTINCT * FROM chat) c, (SELECT unnest(['TOTAL', 'KCDS_ONLY', 'OHS_ONLY']) AS k) k""",
    "blk": """SELECT *, sum(st) OVER (PARTITION BY video_id, s, e ORDER BY ps, pe, speaker ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, CASE WHEN ps - lag(pe) OVER w <= CASE WHEN speaker = lag(speaker) OVER w THEN 1.5 ELSE 8 END THEN 0 ELSE 1 END AS st, coalesce(speaker <> lag(speaker) OVER w, false) AS sw
        FROM ov WHERE t = 'Interacting' AND speaker IN ('KCHI', 'KCDS') WINDOW w AS (PARTITION BY video_id, s, e ORDER BY ps, pe, speaker))""",
    "blocks": """SELECT video_id, s, e, block, sum(CASE WHEN st = 0 AND sw THEN 1 ELSE 0 END) AS turns, arg_min(speaker, (ps, pe, speaker)) AS first_speaker FROM blk GROUP BY video_id, s, e, block""",
    "gts": "SELECT video_id, lower(t) AS label, s, e, CAST(s AS BIGINT) AS o FROM chat",
    "prs": "SELECT video_id, CASE speaker WHEN 'KCHI' THEN 'interacting' WHEN 'KCDS' THEN 'available' ELSE 'alone' END AS label, s, e, turn AS o FROM snip",
    "len": "SELECT video_id, CAST(floor(max(e)) + 1 AS BIGINT) AS n FROM gts GROUP BY 1",
    "pg": "SELECT video_id, sec, max_by(label, o) AS label FROM (SELECT video_id, label, o, unnest(range(CAST(round_even(s, 0) AS BIGINT), least(CAST(round_even(e, 0) AS BIGINT), n - 1) + 1)) AS sec FROM gts JOIN len USING (video_id)) GROUP BY 1, 2",
    "pp": "SELECT video_id, sec, max_by(label, o) AS label FROM (SELECT video_id, label, o, unnest(range(CAST(round_even(s, 0) AS BIGINT), least(CAST(round_even(e, 0) AS BIGINT), n - 1) + 1)) AS sec FROM prs JOIN len USING (video_id)) GROUP BY 1, 2",
    "sec": "SELECT g.video_id, g.sec AS second, g.label AS gt, p.label AS pred FROM pg g JOIN len l USING (video_id) LEFT JOIN pp p USING (video_id, sec) WHERE l.n >= 10 AND EXISTS (SELECT 1 FROM prs WHERE prs.video_id = g.video_id) AND g.sec >= 5 AND g.sec < l.n - 5",
    "rated": "SELECT doc_id // 100 AS video_id, doc_id % 100 AS second, CASE WHEN quality = 1 THEN 'interacting' ELSE 'alone' END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN toxic = 1 THEN 'interacting' ELSE 'alone' END AS b FROM labels",
}


def query(body: str, *parts: str) -> str:
    """body after a WITH list of parts, in their order above, which is that of their dependencies; those that parts need are added."""
    import re

    need, todo = set(), list(parts)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += [n for n in PARTS if n != name and re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", PARTS[name])]
    if not need:
        return body
    recursive = "RECURSIVE " if "fold" in need else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in need) + f" {body}"
