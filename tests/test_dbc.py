import pytest

from buswright import demo
from buswright.sources.dbc import DbcError, Signal, decimals, parse, read_catalogs
from buswright.operators import summaries

KILN = 'BO_ 46 Kiln: 5 OVEN\n SG_ Heat : 5|11@1- (0.125,40) [-88|167.875] "degC" LOG\n'


def extra(record):
    return KILN + f" {record}\n"


def test_every_field_of_a_signal_is_read():
    assert parse(KILN).message(46).signals == (Signal("Heat", 5, 11, False, True, 0.125, 40.0, -88.0, 167.875, "degC"),)
    other = parse(extra('SG_ Draft :  23 | 9 @0+ ( 2e-2 , -.5 ) [ 0 | 1E1 ] "" LOG,HMI')).message(46).signals[1]
    assert other == Signal("Draft", 23, 9, True, False, 0.02, -0.5, 0.0, 10.0, "")


def test_identifiers_of_either_width():
    c = parse("BO_ 2047 A: 1 N\nBO_ 2147485695 B: 1 N\nBO_ 3758096385 C: 1 N\n")
    # bits 29 and 30 are no part of an identifier
    assert sorted(c.by_id) == [(1, True), (2047, False), (2047, True)]


def test_of_two_messages_with_an_identifier_the_later_one_counts():
    c = parse(KILN + "BO_ 46 Cooler: 3 OVEN\n")
    assert [(m.name, m.dlc, m.signals) for m in c] == [("Cooler", 3, ())]


@pytest.mark.parametrize(
    ("text", "line", "says"),
    [
        ('SG_ Heat : 0|4@1+ (1,0) [0|0] "" LOG\n', 1, "outside of a message"),
        ("BO_ 2048 Big: 8 N\n", 1, "wider than 11 bits"),
        ("\nBO_ 0x2E Hex: 8 N\n", 2, "message identifier expected"),
        ("BO_ 46 Long: 256 N\n", 1, "DLC expected"),
        ("BO_ 46 Bare:\n", 1, "before its size"),
        (extra('SG_ Z : 0|0@1+ (1,0) [0|0] "" LOG'), 3, "1 to 64 bits"),
        (extra('SG_ Z : 0|65@1+ (1,0) [0|0] "" LOG'), 3, "1 to 64 bits"),
        (extra('SG_ Z : 0|4@3+ (1,0) [0|0] "" LOG'), 3, "no byte order"),
        (extra('SG_ Z : 0|4@0u (1,0) [0|0] "" LOG'), 3, "neither + nor -"),
        (extra('SG_ Z : 0|4@1+ (one,0) [0|0] "" LOG'), 3, "factor expected"),
        (extra("SG_ Z : 0|4@1+ (1,0) [0|0] LOG"), 3, "quoted unit"),
        (extra('SG_ Z 0|4@1+ (1,0) [0|0] "" LOG'), 3, "before its `:`"),
        (extra('SG_ Z m4M : 0|4@1+ (1,0) [0|0] "" LOG'), 3, "nests"),
        (extra('SG_ Z m : 0|4@1+ (1,0) [0|0] "" LOG'), 3, "number of its page"),
        (extra('SG_ Z page4 : 0|4@1+ (1,0) [0|0] "" LOG'), 3, "stands where"),
        (extra('SG_ Y M : 0|2@1+ (1,0) [0|0] "" LOG\n SG_ Z M : 2|2@1+ (1,0) [0|0] "" LOG'), 4, "by a second signal"),
        (extra('VAL_ 46 Heat warm "yes" ;'), 3, "value table key expected"),
        (extra("VAL_ 500 Heat 3 ;"), 3, "label in quotes is missing"),
        (extra('VAL_ 46 Heat 3 "warm" ;\n SG_ Z : 0|4@1+ (1,0) [0|0] "" LOG'), 4, "outside of a message"),
        (extra("SG_MUL_VAL_ 47 Heat Sel 1-1;"), 3, "message 47"),
    ],
)
def test_a_faulty_record_is_told_with_its_line(text, line, says):
    with pytest.raises(DbcError) as e:
        parse(text)
    assert e.value.line == line and says in str(e.value)


def test_value_tables_over_several_lines_and_without_an_end():
    heat = lambda text: parse(KILN + text).message(46).signals[0].labels
    assert heat('VAL_ 46 Heat 12 "hot"\n -3"cold"\n  0 "" ;\nVAL_ 46 Draft 1 "?" ;\nVAL_ KilnDoor 1 "open" ;\n') == {12: "hot", -3: "cold", 0: ""}
    assert heat('VAL_ 46 Heat 8 "first" 8 "second"\nBA_DEF_ "x";\nBO_ 47 Next: 1 N\n') == {8: "second"}
    assert heat('VAL_ 46 Heat 1 "last line"') == {1: "last line"}


def test_ranges_of_pages_must_be_a_signals_own_page():
    base = 'BO_ 90 Silo: 8 N\n SG_ Bin M : 0|6@1+ (1,0) [0|0] "" L\n SG_ Level m17 : 8|8@1+ (1,0) [0|0] "" L\n'
    assert parse(base + "SG_MUL_VAL_ 90 Level Bin 17-17;\n").message(90).signals[1].mux_page == 17
    for bad in ("17-18", "17-17, 20-20", "16-16"):
        with pytest.raises(DbcError, match="more pages"):
            parse(base + f"SG_MUL_VAL_ 90 Level Bin {bad};\n")
    with pytest.raises(DbcError, match="more pages"):
        parse(base + "SG_MUL_VAL_ 90 Level Chute 17-17;\n")


def test_signals_of_no_message_and_other_records_are_left_out():
    c = parse('VERSION ""\nNS_ :\n BO_TX_BU_\nBU_: N\nBO_ 3221225472 VECTOR__INDEPENDENT_SIG_MSG: 0 N\n SG_ Lost : 0|4@1+ (1,0) [0|0] "" L\nCM_ SG_ 1 Lost "x";\nBA_ "y" 4;\n')
    assert len(c) == 0 and c.signal_count == 0


def test_bytes_that_layouts_need_and_decimals_of_numbers():
    needs = {(5, 11): 2, (5, 12): 3, (0, 64): 8, (1, 64): 9, (23, 9, True): 4, (16, 1, True): 3, (56, 64, True): 16}
    assert {k: Signal("x", *k).required for k in needs} == needs
    assert [decimals(x) for x in (0.125, 2.0, 3e-9, -88.5, 1e30, float("inf"))] == [3, 0, 9, 1, 0, 0]


def test_a_folder_is_read_by_tasks_and_summed_up_by_file(spark, tmp_path):
    (tmp_path / "tram.dbc").write_text(demo.DBC)
    (tmp_path / "bad.dbc").write_text(KILN + " SG_ Z\n")
    (tmp_path / "note.txt").write_text("BO_ 1")
    messages, signals, errors = read_catalogs(spark, str(tmp_path))
    assert messages.count() == 5 and signals.count() == 15
    rows = {r.db: r for r in summaries.corpus_report(messages, signals, errors).collect()}
    assert (rows["tram.dbc"].messages, rows["tram.dbc"].signals, rows["tram.dbc"].error) == (5, 15, None)
    assert (rows["bad.dbc"].messages, rows["bad.dbc"].signals) == (0, 0) and "line 3" in rows["bad.dbc"].error
