from quorumlake.sources import pages


def test_bill_parts(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Bill><Summary><P>Short  one.</P></Summary><Body><S>1</S><T>Text\n here.</T></Body></Bill>")
    (tmp_path / "b.xml").write_text("<Bill>")
    rows = pages.bill_texts(spark, str(tmp_path)).orderBy("path").collect()
    assert (rows[0].body, rows[0].summary, rows[0].error) == ("1 Text here.", "Short one.", None) and rows[1].error and rows[1].body is None


def test_tiles(spark):
    html = '<div class="x"><div class="tile big"><a href="/m/1"><span class="name">Ann <b>Lee</b></span></a><br><p class="party">P</p></div><div class="tile"><span class="name">Bo</span></div></div><p class="name">no</p>'
    got = pages.tiles(spark.createDataFrame([(html,), (None,), ("",)], "h string"), "h", "tile", {"name": "name", "party": "party"}).collect()
    assert [tuple(r) for r in got] == [("/m/1", "Ann Lee", "P"), (None, "Bo", "")]
    assert pages.next_sitting(spark.createDataFrame([("12",), ("128-B",), (None,)], "n string"), "n").first().next == 13
    assert pages.next_sitting(spark.createDataFrame([], "n string"), "n").first().next == 1
