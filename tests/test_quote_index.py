from rostrum.operators import calibration


def test_short_quotes_need_no_place_for_every_character(spark):
    text = "the quick brown fox jumps over the lazy dog while nobody looks at it again and again"
    cues = spark.createDataFrame([(1, i, float(i), i + 1.0, text[a : a + 17].strip()) for i, a in enumerate(range(0, len(text), 17))], "debate long, seq long, start double, end double, text string")
    running = calibration.running_cues(cues)
    whole = " ".join(r.t for r in running.orderBy("seq").collect())
    quotes = [(1, a * 100 + n, whole[a : a + n].strip()) for a in range(0, len(whole) - 30, 5) for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 22, 23, 29)]
    got = {r.id: r["at"] for r in calibration.find_spans(running, spark.createDataFrame(quotes, "debate long, id long, quote string")).collect()}
    assert got == {i: whole.index(q) for _, i, q in quotes if q}
    places = sum(calibration.position_index(running, gram, step).count() for least, gram, step in calibration.CLASSES if least > 1)
    assert places < len(whole)
