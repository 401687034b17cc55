"""Queries over all roots and all ids, against brute force."""

from tidewarden.plans import registry
from tidewarden.sources.tables import Context


def test_closure_of_all_relations(spark, small):
    c = Context(spark, small)
    children = {}
    for r in c.view("v_subrelations").select("parent", "child").where("child is not null").collect():
        children.setdefault(r.parent, set()).add(r.child)
    want = set()
    for (root,) in c.view("customer").select("c_custkey").collect():
        seen, front = {root}, [root]
        while front:
            front = [x for y in front for x in children.get(y, ()) if x not in seen and not seen.add(x)]
        want |= {(root, x) for x in seen}
    got = [tuple(r) for r in registry.QUERIES["relation_closure_all"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lookup_of_all_ids(spark, small):
    c = Context(spark, small)
    names = {r.id: r.name for r in c.view("v_nodes").select("id", "name").collect()}

    def find(i):
        if i not in names:
            return i, "absent", None
        n, dead = (names[i] + " batch", i % 21 == 0) if i % 7 == 0 else (names[i] + " state", i % 15 == 0) if i % 5 == 0 else (names[i], False)
        return i, "deleted" if dead else "value", n

    ids = {i for r in c.view("events").select("event_id", "user_id").collect() for i in r if i is not None}
    got = [tuple(r) for r in registry.QUERIES["overlay_lookup_all"](spark, small).collect()]
    assert len(got) == len(ids) and set(got) == {find(i) for i in ids}
