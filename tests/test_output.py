import pytest

from marlstone.sources import output

NAMES, ROWS = ["a", "b"], [(1, "x,y"), (None, "it's"), (2.5, b"\x01")]
STATED = {
    "list": "1|x,y\n|it's\n2.5|\x01\n",
    "tabs": "1\tx,y\n\tit's\n2.5\t\x01\n",
    "ascii": "1\x1fx,y\x1e\x1fit's\x1e2.5\x1f\x01\x1e",
    "csv": '1,"x,y"\r\n,it\'s\r\n2.5,\x01\r\n',
    "quote": "1,'x,y'\nNULL,'it''s'\n2.5,X'01'\n",
    "insert": "INSERT INTO table VALUES(1,'x,y');\nINSERT INTO table VALUES(NULL,'it''s');\nINSERT INTO table VALUES(2.5,X'01');\n",
    "json": '[{"a":1,"b":"x,y"},\n{"a":null,"b":"it\'s"},\n{"a":2.5,"b":"\\u0001"}]\n',
}


@pytest.mark.parametrize("mode", output.MODES)
def test_modes(mode):
    text = output.render(NAMES, ROWS, mode)
    assert text == STATED.get(mode, text) and "it" in text


def test_grids():
    assert output.render(["k"], [(1,), (22,)], "table") == "+----+\n| k  |\n+----+\n| 1  |\n| 22 |\n+----+\n"
    assert output.render(["k"], [(1,)], "markdown") == "| k |\n|---|\n| 1 |\n"
    with pytest.raises(ValueError):
        output.render(["k"], [], "other")
