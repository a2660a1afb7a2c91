"""Links that only some bands show, inputs whose rows come in another order each time, and runs without a shared folder."""

from pyspark.sql import functions as F

from inkwell.llm import _tables, near, order_minhash
from tests.llm.conftest import words
from tests.llm.test_operators import rows


def test_a_link_is_found_in_whichever_order_its_bands_are_listed(spark, monkeypatch):
    """A chain d1 - d3 - d4 - d2; d1 shares a bucket with d3, d2 another with d4, and d3 and d4 share both, listed in turn."""
    own = words(8, 124)
    window = {k: " ".join(own[8 * i : 8 * i + 100]) for i, k in enumerate((1, 3, 4, 2))}
    docs = spark.createDataFrame([(k, window[k]) for k in (1, 2, 3, 4)], "doc_id long, text string").coalesce(1)
    sketches = near.sketches
    for order in ({3: (2, 5), 4: (5, 2)}, {3: (5, 2), 4: (2, 5)}, {3: (2, 5), 4: (2, 5)}):
        listed = {1: (2,), 2: (5,), **order}
        case = F
        for k, bands in listed.items():
            case = case.when(F.col("id") == k, F.array(*(F.lit(b).cast("long") for b in bands)))
        monkeypatch.setattr(near, "sketches", lambda *a, case=case: sketches(*a).withColumn("bands", case))
        assert {r["class_size"] for r in rows(near.near_classes(docs))} == {4}


def test_fingerprints_of_a_table_in_another_order_each_time(spark, documents, edge):
    for docs in (documents, edge):
        again = docs.repartition(5, F.rand())
        key = lambda r: tuple((x is None, x) for x in r.values())
        wanted = sorted(rows(order_minhash.fingerprint_documents(docs)), key=key)
        assert sorted(rows(order_minhash.fingerprint_documents(again)), key=key) == wanted and len(wanted) == docs.count()


def test_local_runs_without_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local[4]"
        getConf = staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    monkeypatch.setattr(_tables, "_local", [])
    assert _tables.shared_folder(Session()) == _tables.shared_folder(Session())
    Context.master = "spark://host:7077"
    monkeypatch.setattr(_tables, "_local", [])
    try:
        _tables.shared_folder(Session())
        raise AssertionError
    except ValueError:
        pass
