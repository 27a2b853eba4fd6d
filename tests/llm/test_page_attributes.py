import pytest

from keyloom.llm import page_wrappers as pw


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'style="overflow-x: hidden"', "aria-hidden=false", 'data-id="comments"',
                                        'data-role="menu"', "title='role=menu class=ad hidden'", 'data-class=sidebar id="main"'])
@pytest.mark.parametrize("tag", ["body", "article", "main", "div"])
def test_other_attributes_and_values_mark_nothing(tag, attributes):
    assert pw.main_text(f"<html><{tag} {attributes}><p>All the text</{tag}></html>", None) == "All the text"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "hidden=until-found", "role=menu", 'id = "comments"', "class='a sidebar'",
                                        'style="x" hidden', "id=a/hidden hidden"])
def test_exact_names_still_mark(attributes):
    assert pw.main_text(f"<body><p>Kept<div {attributes}><p>Gone</div></body>", None) == "Kept"


@pytest.mark.parametrize("attributes", ["hidden", "role=menu", "class=sidebar"])
def test_the_page_itself_is_never_skipped(attributes):
    assert pw.main_text(f"<html {attributes}><body {attributes}><p>Kept</body></html>", None) == "Kept"


def test_the_first_of_repeated_attributes_holds():
    assert pw._marked("div", " class=story class=ad", False) == ("div.story", False)
