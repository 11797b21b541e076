import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.operators import em
from tidemark.operators import kernels as kn
from tidemark.operators import models as md
from tidemark.operators.packing import number_complete_rows, pack
from tidemark.operators.regimes import adjusted_rand

KEYS = ["series_id"]
FEATS = ["x0", "x1"]


def planted(n=600, seed=0):
    rng = np.random.default_rng(seed)
    state = np.repeat(np.arange(n // 50) % 3, 50)
    x = rng.normal(0, 1, (n, 2)) + np.array([[4, 0], [-4, 1], [0, -4]])[state]
    return pd.DataFrame(
        {"series_id": "a", "date": pd.date_range("2015-01-01", periods=n).date, "x0": x[:, 0], "x1": x[:, 1], "truth": state}
    )


@pytest.fixture(scope="module")
def data(spark):
    pdf = planted()
    other = planted(seed=1).assign(series_id="b")
    df = spark.createDataFrame(pd.concat([pdf, other]), "series_id string, date date, x0 double, x1 double, truth int")
    rows = number_complete_rows(df, KEYS, FEATS).cache()
    return rows, pack(rows, KEYS, FEATS, size=64)


@pytest.fixture(scope="module")
def hmm(data):
    models = md.model_table(data[1], KEYS, [3])
    return md.hmm_fit(data[1], models, KEYS, 2, max_iter=6, size=64, gmm_iter=3, kmeans_iter=3)


def brute_force(p, x, k=3):
    """Plain recursions over one whole sequence."""
    mu, va = np.reshape(p["means"], (k, -1)), np.reshape(p["vars"], (k, -1))
    la, lp = np.log(np.reshape(p["trans"], (k, k)) + kn.EPS), np.log(np.asarray(p["start"]) + kn.EPS)
    lb = np.stack([-0.5 * (np.log(2 * np.pi * va[i]) + (x - mu[i]) ** 2 / va[i]).sum(1) for i in range(k)], 1)
    lse = lambda v, ax: v.max(ax) + np.log(np.exp(v - np.expand_dims(v.max(ax), ax)).sum(ax))
    f, b = [lp + lb[0]], [np.zeros(k)]
    for t in range(1, len(x)):
        f.append(lb[t] + lse(f[-1][:, None] + la, 0))
        b.append(lse(la + (lb[-t] + b[-1])[None], 1))
    ll = lse(f[-1], 0)
    v, back = lp + lb[0], []
    for t in range(1, len(x)):
        o = v[:, None] + la
        back.append(o.argmax(0))
        v = o.max(0) + lb[t]
    path = [int(v.argmax())]
    for step in back[::-1]:
        path.append(int(step[path[-1]]))
    return ll, np.exp(np.array(f) + np.array(b[::-1]) - ll), path[::-1]


@pytest.mark.parametrize("chain", [512, 3])
def test_hmm_agrees_with_plain_recursions(data, hmm, monkeypatch, chain):
    rows, packed = data
    monkeypatch.setattr(md, "CHAIN", chain)
    p = hmm.filter("series_id = 'a'")
    x = rows.filter("series_id = 'a'").orderBy("_pos").select(*FEATS).toPandas().to_numpy()
    ll, gamma, path = brute_force(p.first(), x)
    assert md.hmm_score(packed, p, KEYS, 2, 64).first()["log_likelihood"] == pytest.approx(ll, rel=1e-10)
    post = md.hmm_posterior(packed, p, KEYS, 2, 64).orderBy("pos").toPandas()
    assert np.allclose(np.stack(post.proba), gamma, atol=1e-8)
    assert md.hmm_decode(packed, p, KEYS, 2, 64).orderBy("pos").toPandas().state.tolist() == path


def test_hmm_on_a_sub_range(data, hmm):
    rows, packed = data
    p = hmm.filter("series_id = 'b'").withColumns({"lo": F.lit(130).cast("long"), "hi": F.lit(333).cast("long")})
    x = rows.filter("series_id = 'b'").orderBy("_pos").select(*FEATS).toPandas().to_numpy()[130:333]
    ll, _, path = brute_force(p.first(), x)
    got = md.hmm_decode(packed, p, KEYS, 2, 64).orderBy("pos").toPandas()
    assert got.pos.tolist() == list(range(130, 333)) and got.state.tolist() == path
    assert md.hmm_score(packed, p, KEYS, 2, 64).first()["log_likelihood"] == pytest.approx(ll, rel=1e-10)


def test_planted_states_are_found(data, hmm):
    rows, packed = data
    states = md.hmm_decode(packed, hmm, KEYS, 2, 64).join(hmm.select("model_id", *KEYS), "model_id")
    both = rows.withColumnRenamed("_pos", "pos").join(states, [*KEYS, "pos"])
    assert all(r["ari"] > 0.95 for r in adjusted_rand(both, KEYS, "state", "truth").collect())
    for r in hmm.collect():
        t = np.reshape(r["trans"], (3, 3))
        assert np.allclose(t.sum(1), 1) and np.diag(t).min() > 0.9 and sum(r["start"]) == pytest.approx(1)


def whole_rows(rows, series):
    x = rows.filter(f"series_id = '{series}'").orderBy("_pos").select(*FEATS).toPandas().to_numpy()
    return x, kn.rows_of(x.ravel(), len(x), 0, 16384, 2, 0, len(x), np.zeros(2), np.ones(2))


def machine(rows, phases, starts=1, limit=100, tol=1e-3, theta=None, k=3, **more):
    """Passes of one fit until it rests: (state, the likelihoods that each pass saw)."""
    state, seen = em.begin(k, rows.x.shape[2], 42, phases, starts, dict.fromkeys(("kmeans", "gmm", "hmm"), (limit, tol)), theta, **more), []
    while state["phase"] != "done":
        sums = em.gather(state, rows)
        seen.append((state["phase"], sums["ll"].copy() if "ll" in sums else None))
        em.absorb(state, sums)
    return state, seen


def test_one_round_equals_plain_baum_welch(data):
    x, rows = whole_rows(data[0], "a")
    theta = machine(rows, ["seed", "kmeans", "gmm"], limit=2)[0]["theta"]
    state = em.begin(3, 2, 42, ["hmm"], 1, {"hmm": (9, 1e-9)}, theta)
    p = dict(zip(("means", "vars", "start", "trans"), (a[0] for a in em.parameters(state, state["v"]))))
    ll, gamma, _ = brute_force(p, x)
    sums = em.gather(state, rows)
    assert sums["ll"][0] == pytest.approx(ll)
    em.absorb(state, sums)
    means, vars_, start, trans = (a[0] for a in em.parameters(state, state["v"]))
    w = gamma.sum(0)[:, None]
    mu = gamma.T @ x / w
    assert np.allclose(means, mu) and np.allclose(start, gamma[0]) and np.allclose(trans.sum(1), 1)
    assert np.allclose(vars_, np.maximum(gamma.T @ x**2 / w - mu**2, em.MIN_COVAR))


@pytest.mark.parametrize("phases", [["seed", "kmeans"], ["seed", "kmeans", "gmm"], ["seed", "kmeans", "gmm", "hmm"]])
def test_likelihood_does_not_fall(data, phases, monkeypatch):
    """Without extrapolation at every pass, with it over the accepted points."""
    _, rows = whole_rows(data[0], "b")
    state, _ = machine(rows, phases, tol=1e-9)
    monkeypatch.setattr(em, "FARTHEST", 1.0)
    plain, seen = machine(rows, phases, tol=1e-9)
    for phase in phases[1:]:
        assert (np.diff([ll[0] for p, ll in seen if p == phase]) > -1e-7).all()
    assert state["ll"] >= plain["ll"] - 1e-6 * abs(plain["ll"])


def slow_rows(n=3000):
    """Two components that overlap: plain EM needs many rounds."""
    rng = np.random.default_rng(2)
    x = np.where(rng.random((n, 1)) < 0.4, rng.normal(-0.8, 1, (n, 1)), rng.normal(0.8, 1.1, (n, 1)))
    return kn.rows_of(x.ravel(), n, 0, 16384, 1, 0, n, np.zeros(1), np.ones(1))


def test_extrapolation_saves_passes_to_the_same_point(monkeypatch):
    rows = slow_rows()
    limits = {"limit": 20_000, "tol": 1e-11, "k": 2}
    fast, seen = machine(rows, ["seed", "kmeans", "gmm"], **limits)
    monkeypatch.setattr(em, "FARTHEST", 1.0)
    slow, all_seen = machine(rows, ["seed", "kmeans", "gmm"], **limits)
    count = lambda s: sum(p == "gmm" for p, _ in s)
    assert count(seen) < count(all_seen) / 3
    assert fast["rest"] and slow["rest"] and fast["ll"] >= slow["ll"] - 1e-3
    assert np.allclose(fast["theta"]["means"], slow["theta"]["means"], atol=0.05)


@pytest.mark.parametrize("kind", ["kmeans", "gmm", "hmm"])
def test_links_of_any_length_give_the_same_fit(data, kind):
    """Ten links per model and one job per pass, or one link and one job."""
    rows, many = data
    one = pack(rows, KEYS, FEATS)
    fit = getattr(md, f"{kind}_fit")
    fits = [fit(p, md.model_table(p, KEYS, [2, 3]), KEYS, 2, size=s, starts=2, **({"max_iter": 6})) for p, s in ((many, 64), (one, 16384))]
    a, b = (f.orderBy("model_id").toPandas() for f in fits)
    assert a.model_id.tolist() == b.model_id.tolist() and len(a) == 4 and (a["rounds"] == b["rounds"]).all()
    assert np.allclose(a.log_likelihood, b.log_likelihood)
    for c in ("means", "vars", "start", "trans", "scores"):
        assert all(np.allclose(x, y, atol=1e-7) for x, y in zip(a[c], b[c])), c


def test_seeding_finds_what_random_rows_miss(data):
    """Every start of the oversampled seeding reaches the inertia of the true centres."""
    rows, packed = data
    km = md.kmeans_fit(packed, md.model_table(packed, KEYS, [3]), KEYS, 2, size=64).collect()
    for r in km:
        x, _ = whole_rows(rows, r["series_id"])
        cost = ((x[:, None] - np.reshape(r["means"], (3, 2))) ** 2).sum(2).min(1).sum()
        assert r["log_likelihood"] == pytest.approx(-cost) and len(r["scores"]) == 10
        assert max(r["scores"]) == pytest.approx(r["log_likelihood"]) and min(r["scores"]) > 1.05 * max(r["scores"])


def switching(rows, packed, size):
    models = md.model_table(packed, KEYS, [2])
    fit = md.msr_fit(packed, models, KEYS, size=size, starts=5)
    return fit, md.msr_probabilities(packed, fit, KEYS, size)


def test_switching_regression_equals_plain_filter(spark):
    rng = np.random.default_rng(5)
    state = np.repeat(np.arange(12) % 2, 50)
    pdf = pd.DataFrame({"series_id": "s", "date": pd.date_range("2015-01-01", periods=600).date, "r": rng.normal(np.array([0.4, -0.6])[state], np.array([0.5, 1.6])[state])})
    rows = number_complete_rows(spark.createDataFrame(pdf), KEYS, ["r"]).cache()
    x = rows.orderBy("_pos").toPandas().r.to_numpy()
    for size in (64, 16384):
        fit, found = switching(rows, pack(rows, KEYS, ["r"], size=size), size)
        p = fit.first()
        mu, va, tr = np.array(p["means"]), np.array(p["vars"]), np.reshape(p["trans"], (2, 2))
        assert np.allclose(np.array(p["start"]) @ tr, p["start"], atol=1e-6) and p["log_likelihood"] >= max(p["scores"]) - 1e-2 and len(p["scores"]) == 5
        dens = np.exp(-0.5 * (x[:, None] - mu) ** 2 / va) / np.sqrt(2 * np.pi * va)
        ahead, filtered, predicted = np.array(p["start"]), [], []
        for row in dens:
            predicted.append(ahead)
            now = ahead * row
            filtered.append(now / now.sum())
            ahead = filtered[-1] @ tr
        smooth = [filtered[-1]]
        for t in range(len(x) - 2, -1, -1):
            smooth.insert(0, filtered[t] * (tr @ (smooth[0] / predicted[t + 1])))
        got = found.orderBy("pos").toPandas()
        assert np.allclose(np.stack(got.filtered), filtered, atol=1e-7) and np.allclose(np.stack(got.smoothed), smooth, atol=1e-7)
        low = int(mu.argmin())
        assert ((np.stack(got.smoothed)[:, low] > 0.5) == (state == 1)).mean() > 0.9


def test_soft_shares_sum_to_one(data):
    _, packed = data
    km = md.kmeans_fit(packed, md.model_table(packed, KEYS, [2, 3], [1, 2]), KEYS, 2, max_iter=3, size=64)
    best = md.best_seed(km, KEYS)
    assert best.count() == 4
    for table in (md.kmeans_assign(packed, best, KEYS, 2, 64), md.gmm_assign(packed, best, KEYS, 2, 64)):
        sums = table.select(F.aggregate("proba", F.lit(0.0), lambda a, v: a + v).alias("s")).toPandas().s
        assert np.allclose(sums, 1.0) and len(sums) == 2400


def test_five_rows(spark):
    pdf = pd.DataFrame(np.random.default_rng(0).normal(size=(5, 3)), columns=["p", "q", "r"])
    pdf = pdf.assign(series_id="t", date=pd.date_range("2020-01-01", periods=5).date)
    rows = number_complete_rows(spark.createDataFrame(pdf), KEYS, ["p", "q", "r"])
    packed = pack(rows, KEYS, ["p", "q", "r"])
    fit = md.hmm_fit(packed, md.model_table(packed, KEYS, [3]), KEYS, 3, max_iter=3)
    assert md.hmm_decode(packed, fit, KEYS, 3).count() == 5


def test_criteria(spark):
    p = spark.createDataFrame([(3, 0, 1000, -50.0)], "k int, lo long, hi long, log_likelihood double")
    r = md.information_criteria(p, "hmm", 4).first()
    assert r["aic"] == 2 * (2 + 6 + 24) + 100 and r["bic"] == pytest.approx(32 * np.log(1000) + 100)
    assert md.information_criteria(p, "gmm", 4).first()["aic"] == 2 * (2 + 24) + 100
    assert md.information_criteria(p, "kmeans", 4).first()["bic"] == 9999.0


def test_silhouettes(data):
    rows, _ = data
    one = rows.filter("series_id = 'a'")
    x, c = one.select(*FEATS).toPandas().to_numpy(), one.select("truth").toPandas().truth.to_numpy()

    def brute(d):
        out = []
        for i in range(len(x)):
            m = [d[i][(c == g) & (np.arange(len(x)) != i)].mean() for g in range(3)]
            a, b = m[c[i]], min(m[g] for g in range(3) if g != c[i])
            out.append((b - a) / max(a, b))
        return np.mean(out)

    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert md.silhouette_squared(one, KEYS, "truth", FEATS).first()["silhouette"] == pytest.approx(brute(d2))
    arrays = one.select("series_id", "truth", F.array(*FEATS).alias("x"))
    assert md.silhouette_squared(arrays, KEYS, "truth", "x").first()["silhouette"] == pytest.approx(brute(d2))
    assert md.silhouette_squared(arrays, [], "truth", "x").first()["silhouette"] == pytest.approx(brute(d2))


def test_tables_and_storage(data, hmm, tmp_path, spark):
    md.save_params(hmm, str(tmp_path / "p"))
    back = md.load_params(spark, str(tmp_path / "p"))
    assert back.count() == 2
    t = md.transition_table(back, KEYS).groupBy("model_id", "from_state").agg(F.sum("p").alias("s")).toPandas()
    assert np.allclose(t.s, 1) and len(t) == 6
    e = md.emission_table(back, KEYS, FEATS)
    assert e.count() == 12 and set(md.summarize(back, KEYS).columns) >= {"log_likelihood", "converged"}


def test_registered_fits_run_to_the_tolerance(monkeypatch):
    """No registered query cuts the rounds of a fit below the default."""
    from tidemark.catalog import models as cm
    from tidemark.operators import walkforward as wf

    class Seen(Exception):
        pass

    given = {}

    def fit(*args, **options):
        given[name] = options
        raise Seen

    for stub in ("scaled_features", "_raw_features"):
        monkeypatch.setattr(cm, stub, lambda *a: None)
    monkeypatch.setattr(cm, "prepared", lambda *a: (None, None))
    monkeypatch.setattr(cm, "stage", lambda df: df)
    monkeypatch.setattr(md, "model_table", lambda *a: None)
    for kind in ("kmeans_fit", "gmm_fit", "hmm_fit"):
        monkeypatch.setattr(md, kind, fit)
    for kind in ("model_sweep", "seed_sensitivity", "train_test_stability", "walk_forward_regimes", "walk_forward_oos", "oos_partitions"):
        monkeypatch.setattr(wf, kind, fit)
    names = [n for n in cm.QUERIES if n not in ("walk_forward_folds", "embedding_clusters", "silhouette_squared")]
    for name in names:
        with pytest.raises(Seen):
            cm.QUERIES[name](None, "")
    assert not [(n, o) for n, o in given.items() if o.keys() & {"max_iter", "gmm_iter", "kmeans_iter", "tol"}]
    assert set(given) == set(names)
