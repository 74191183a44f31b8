from noteglass.operators import sessions
from noteglass.session import table


def test_least_chars_is_the_rendered_length(spark, data):
    rows = sessions.once(table(spark, data, "transcripts"))
    short = {r.id for r in sessions.render(rows).collect() if len(r.text) < 6000}
    assert short
    found = sessions.violations(rows, 6000)
    assert {r.id for r in found.where("rule = 'too few characters'").collect()} == short
    assert sorted(found.where("rule <> 'too few characters'").collect()) == sorted(sessions.violations(rows).collect())
