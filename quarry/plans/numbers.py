"""Queries on layers, distributions and poses as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.functions import distributions as D
from quarry.functions import neural as N
from quarry.functions import poses as P
from quarry.functions import waves as W
from quarry.plans.common import rounded, table
from quarry.plans.waves import _d, _S, _x, digest


def _rows(**columns):
    return lambda spark, d: rounded(_x(spark, d).select("vec_id", *(f().alias(k) for k, f in columns.items())), 6)


def _grid(m):
    """A matrix as one number."""
    return digest(F.flatten(m))


def _density(**made):
    return lambda spark, d: rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(f(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias(k) for k, f in made.items())), 6)


WEIGHTS, BIAS = [[0.5, -1.0, 2.0], [1.5, 0.25, -0.75]], [0.1, -0.2]
_three = lambda: F.slice("x", 1, 3)
_sequence = lambda: W.chunk_signal(F.slice("x", 1, 16), 4)
LINKS = [(1.0, 0.0, 0.0), (0.5, 0.0, 0.0)]
ARM = [(0.0, math.pi / 2, 0.3), (0.5, 0.0, 0.0), (0.4, 0.0, 0.0)]
_joints = lambda: F.slice("x", 1, 2)
_rpy = lambda: P.rpy_to_matrix(F.col("x")[0], F.col("x")[1], F.col("x")[2])
_pose = lambda: P.homogeneous(_rpy(), F.slice("x", 4, 3))
_there = lambda: P.joint_trajectory(F.slice("x", 1, 3), F.slice("x", 4, 3), F.lit(0.3), 1.0, "cubic")


def _identity(spark, d):
    rows = _x(spark, d).select("vec_id", "x", _pose().alias("t"))
    both = rows.select("vec_id", P.product("t", P.inverted("t")).alias("i"), P.transformed(P.inverted("t"), P.transformed("t", F.array(F.slice("x", 7, 3))))[0].alias("p"), F.slice("x", 7, 3).alias("q"))
    return rounded(both.select("vec_id", _grid("i").alias("unit"), (F.array_max(F.zip_with("p", "q", lambda a, b: F.abs(a - b))) < 1e-9).alias("back")), 6)


def _turns(spark, d):
    """Angles to 15 digits first: what the sines leave beyond would turn a half at the last digit."""
    rows = _x(spark, d).select("vec_id", "x", _rpy().alias("m"))
    q = rows.select("vec_id", "x", "m", P.matrix_to_euler("m").alias("e"), P.quaternion_to_matrix(P.matrix_to_quaternion("m")).alias("n"), P.euler_to_matrix(F.slice("x", 1, 3)).alias("o"))
    return rounded(q.select("vec_id", *(F.round(F.col("e")[k], 15).alias(f"a{k}") for k in range(3)), *((F.abs(_grid(c) - _grid("m")) < 1e-9).alias(k) for k, c in (("quaternion", "n"), ("euler", "o")))), 6)


def _reached(spark, d):
    rows = _x(spark, d).select("vec_id", (1 + F.col("x")[0] / 2).alias("px"), (F.col("x")[1] / 2).alias("py"))
    q = rows.withColumn("q", P.inverse_planar_2r(1.0, 0.5, "px", "py")).withColumn("p", P.forward_kinematics(LINKS, "q"))
    return rounded(q.select("vec_id", F.when(F.col("q").isNotNull(), F.col("p")[0][3]).alias("x"), F.when(F.col("q").isNotNull(), F.col("p")[1][3]).alias("y")), 6)


QUERIES = {
    "nn_activations": _rows(relu=lambda: digest(N.relu("x")), leaky=lambda: digest(N.leaky_relu("x")), tanh=lambda: digest(N.tanh("x")), sigmoid=lambda: digest(N.sigmoids("x")), gelu=lambda: digest(N.gelu("x")), softmax=lambda: digest(N.softmax("x")), lse=lambda: N.log_sum_exp("x"), norm=lambda: digest(N.layer_norm("x"))),
    "nn_layers": _rows(dense=lambda: digest(N.dense(_three(), WEIGHTS, BIAS)), batch=lambda: digest(N.batch_norm(_three(), [0.1, 0.2, 0.3], [1.0, 4.0, 0.25], 0.0)), pool=lambda: digest(N.pooled("x", 4)), average=lambda: digest(N.pooled("x", 4, "avg")), mean=lambda: digest(N.average_pool(_sequence())), flat=lambda: digest(N.flatten(_sequence())), embedded=lambda: digest(F.flatten(N.embedding(F.array(F.lit(1), F.lit(0)), WEIGHTS))) + 0 * F.col("x")[0]),
    "nn_losses": _rows(mse=lambda: N.mse_loss("x", F.reverse("x")), cross=lambda: N.cross_entropy("x", F.lit(3)), binary=lambda: N.binary_cross_entropy(N.sigmoid(F.col("x")[0]), F.lit(1.0)), clipped=lambda: digest(N.clip_gradients("x", 0.5)), recurrent=lambda: N.rnn(_three(), 0.7, -0.4, 0.1)),
    "nn_attention": _rows(pooled=lambda: digest(N.attention_pool(_sequence(), [1.0, -1.0, 0.5, 2.0])), attended=lambda: _grid(N.attention(_sequence(), _sequence(), _sequence()))),
    "dist_log_density": _density(
        normal=lambda q, x: D.Normal(25.0, 10.0).log_density(q), uniform=lambda q, x: D.Uniform(0.0, 60.0).log_density(q), exponential=lambda q, x: D.Exponential(0.1).log_density(q), lognormal=lambda q, x: D.LogNormal(3.0, 0.5).log_density(q), gamma=lambda q, x: D.Gamma(3.0, 0.2).log_density(q),
        chi2=lambda q, x: D.Chi2(7.0).log_density(q), student=lambda q, x: D.StudentT(5.0).log_density(q / 10), poisson=lambda q, x: D.Poisson(20.0).log_density(F.floor(q).cast("double")), beta=lambda q, x: D.Beta(2.0, 5.0).log_density(x + 0.1), bernoulli=lambda q, x: D.Bernoulli(0.3).log_density((q > 25).cast("int")),
        dirichlet=lambda q, x: D.Dirichlet([2.0, 3.0]).log_density(F.array(x + 0.1, 0.9 - x)), log_gamma=lambda q, x: D.log_gamma(q + 0.5)),
    "dist_shares": _density(uniform=lambda q, x: D.Uniform(0.0, 60.0).share(q), exponential=lambda q, x: D.Exponential(0.1).share(q), density=lambda q, x: D.Normal(25.0, 10.0).density(q), steps=lambda q, x: D.digamma(q + 1) - D.digamma(q)),
    "dist_entropy": lambda spark, d: rounded(table(spark, d, "embeddings").select("vec_id", D.entropy(F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 10).cast("double")), 2).alias("entropy")), 6),
    "pose_rotations": _rows(x=lambda: _grid(P.rot_x(F.col("x")[0])), y=lambda: _grid(P.rot_y(F.col("x")[0])), z=lambda: _grid(P.rot_z(F.col("x")[0])), skewed=lambda: _grid(P.skew(_three())), unskewed=lambda: digest(P.unskew(P.skew(_three()))), wrapped=lambda: P.wrap_angle(F.col("x")[0] * 40)),
    "pose_turns": _turns, "pose_inverse": _identity, "pose_reach": _reached,
    "pose_chain": _rows(end_x=lambda: P.forward_kinematics(LINKS, _joints())[0][3], end_y=lambda: P.forward_kinematics(LINKS, _joints())[1][3], places=lambda: _grid(P.chain_positions(LINKS, _joints())), jacobian=lambda: _grid(P.planar_2r_jacobian(1.0, 0.5, _joints())), geometric=lambda: _grid(F.slice(P.geometric_jacobian(LINKS, _joints()), 1, 2))),
    "pose_clearance": _rows(
        segment=lambda: P.point_segment_distance(_three(), F.slice("x", 4, 3), F.slice("x", 7, 3)), sphere=lambda: P.sphere_clearance(_three(), [0.1, 0.2, 0.3], 0.05), box=lambda: P.box_clearance(_three(), [-0.1, -0.1, -0.1], [0.1, 0.1, 0.1]),
        capsule=lambda: P.capsule_clearance(_three(), [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], 0.1), violation=lambda: P.limit_violation(_three(), [-0.1, -0.1, -0.1], [0.1, 0.1, 0.1]), inside=lambda: P.within_limits(_three(), [-0.1, -0.1, -0.1], [0.1, 0.1, 0.1]), clipped=lambda: digest(P.clipped(_three(), [-0.1, -0.1, -0.1], [0.1, 0.1, 0.1]))),
    "pose_motion": _rows(cubic=lambda: P.cubic_scaling(F.col("x")[0] + 0.5), quintic=lambda: P.quintic_scaling(F.col("x")[0] + 0.5), there=lambda: digest(_there()), between=lambda: digest(P.interpolated(_three(), F.slice("x", 4, 3), 0.25))),
}
_ld = lambda e: f"round({e}, 6)"
_LI = "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS x FROM lineitem) SELECT l_orderkey, l_linenumber, "
_sm = lambda s: f"list_transform({s}, lambda sv: exp(sv) / list_sum(list_transform({s}, lambda su: exp(su))))"
_SEQ = "list_transform(range(0, 4), lambda ck: list_slice(x, ck * 4 + 1, ck * 4 + 4))"
_c3 = "sqrt((x[1] - {0}) ^ 2 + (x[2] - {1}) ^ 2 + (x[3] - {2}) ^ 2)"
_g = "list_transform(range(1, 4), lambda i: greatest(-0.1 - x[i], x[i] - 0.1))"
_cl = "list_transform(range(1, 4), lambda i: least(greatest(x[i], -0.1), 0.1))"
_cub = lambda s: f"(least(1.0, greatest(0.0, {s})) ^ 2 * (3 - 2 * least(1.0, greatest(0.0, {s}))))"
_qui = lambda s: f"(least(1.0, greatest(0.0, {s})) ^ 3 * (10 - 15 * least(1.0, greatest(0.0, {s})) + 6 * least(1.0, greatest(0.0, {s})) ^ 2))"
ORACLES = {
    "nn_activations": f"""{_S} SELECT vec_id, {_ld(_d('list_transform(x, lambda v: greatest(v, 0))'))} AS relu, {_ld(_d('list_transform(x, lambda v: CASE WHEN v > 0 THEN v ELSE 0.01 * v END)'))} AS leaky, {_ld(_d('list_transform(x, lambda v: tanh(v))'))} AS tanh,
 {_ld(_d('list_transform(x, lambda v: 1 / (1 + exp(-v)))'))} AS sigmoid, {_ld(_d('list_transform(x, lambda v: 0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v ^ 3))))'))} AS gelu, {_ld(_d(_sm('x')))} AS softmax, {_ld('ln(list_sum(list_transform(x, lambda v: exp(v))))')} AS lse,
 {_ld(_d('list_transform(x, lambda v: (v - m) / sqrt(d * d + 1e-5))'))} AS norm FROM t""",
    "nn_layers": f"""{_S} SELECT vec_id, {_ld('0.5 * x[1] - x[2] + 2 * x[3] + 0.1 + 2 * (1.5 * x[1] + 0.25 * x[2] - 0.75 * x[3] - 0.2)')} AS dense, {_ld('(x[1] - 0.1) + 2 * (x[2] - 0.2) / 2 + 3 * (x[3] - 0.3) / 0.5')} AS batch,
 {_ld(_d('list_transform(range(0, 16), lambda k: list_max(list_slice(x, k * 4 + 1, k * 4 + 4)))'))} AS pool, {_ld(_d('list_transform(range(0, 16), lambda k: list_avg(list_slice(x, k * 4 + 1, k * 4 + 4)))'))} AS average,
 {_ld(_d('list_transform(range(1, 5), lambda i: (x[i] + x[i + 4] + x[i + 8] + x[i + 12]) / 4)'))} AS mean, {_ld(_d('list_slice(x, 1, 16)'))} AS flat, {_ld('1.5 + 0.5 - 2.25 + 2.0 - 5.0 + 12.0 + 0 * x[1]')} AS embedded FROM t""",
    "nn_losses": f"""{_S}, u AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n2 FROM t) SELECT vec_id, {_ld('list_avg(list_transform(x, lambda v, i: (v - x[65 - i]) ^ 2))')} AS mse, {_ld('ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[4]')} AS "cross",
 {_ld('-ln(1 / (1 + exp(-x[1])))')} AS "binary", {_ld(_d('x') + ' * CASE WHEN n2 > 0.5 THEN 0.5 / n2 ELSE 1 END')} AS clipped, {_ld('tanh(0.7 * x[3] - 0.4 * tanh(0.7 * x[2] - 0.4 * tanh(0.7 * x[1] + 0.1) + 0.1) + 0.1)')} AS recurrent FROM u""",
    "nn_attention": f"""{_S}, sq AS (SELECT vec_id, {_SEQ} AS s FROM t), w AS (SELECT *, {_sm('list_transform(s, lambda r: r[1] - r[2] + 0.5 * r[3] + 2 * r[4])')} AS w,
 list_transform(s, lambda a: list_transform(s, lambda b: exp(list_sum(list_transform(range(1, 5), lambda i: a[i] * b[i])) / 2))) AS e FROM sq), p AS (SELECT *, list_transform(e, lambda r: list_transform(r, lambda v: v / list_sum(r))) AS p FROM w)
 SELECT vec_id, {_ld(_d('list_transform(range(1, 5), lambda i: list_sum(list_transform(range(1, 5), lambda k: s[k][i] * w[k])))'))} AS pooled, {_ld(_d('flatten(list_transform(p, lambda r: list_transform(range(1, 5), lambda i: list_sum(list_transform(range(1, 5), lambda k: s[k][i] * r[k])))))'))} AS attended FROM p""",
    "dist_log_density": f"""{_LI} {_ld('-0.5 * ((q - 25) / 10) ^ 2 - ln(10 * sqrt(2 * pi()))')} AS normal, {_ld('-ln(60.0)')} AS uniform, {_ld('ln(0.1) - 0.1 * q')} AS exponential, {_ld('-0.5 * ((ln(q) - 3) / 0.5) ^ 2 - ln(0.5 * sqrt(2 * pi())) - ln(q)')} AS lognormal,
 {_ld('3 * ln(0.2) - lgamma(3.0) + 2 * ln(q) - 0.2 * q')} AS gamma, {_ld('3.5 * ln(0.5) - lgamma(3.5) + 2.5 * ln(q) - 0.5 * q')} AS chi2, {_ld('lgamma(3.0) - lgamma(2.5) - 0.5 * ln(5 * pi()) - 3 * ln(1 + (q / 10) ^ 2 / 5)')} AS student, {_ld('floor(q) * ln(20.0) - 20 - lgamma(floor(q) + 1)')} AS poisson,
 {_ld('lgamma(7.0) - lgamma(2.0) - lgamma(5.0) + ln(x + 0.1) + 4 * ln(0.9 - x)')} AS beta, {_ld('CASE WHEN q > 25 THEN ln(0.3) ELSE ln(0.7) END')} AS bernoulli, {_ld('lgamma(5.0) - lgamma(2.0) - lgamma(3.0) + ln(x + 0.1) + 2 * ln(0.9 - x)')} AS dirichlet, {_ld('lgamma(q + 0.5)')} AS log_gamma FROM l""",
    "dist_shares": f"{_LI} {_ld('q / 60')} AS uniform, {_ld('1 - exp(-0.1 * q)')} AS exponential, {_ld('exp(-0.5 * ((q - 25) / 10) ^ 2) / (10 * sqrt(2 * pi()))')} AS density, {_ld('1 / q')} AS steps FROM l",
    "dist_entropy": "WITH c AS (SELECT vec_id, list_filter(list_transform(embedding, lambda v: floor(abs(CAST(v AS DOUBLE)) * 10)), lambda v: v > 0) AS c FROM embeddings) SELECT vec_id, round(coalesce(list_sum(list_transform(c, lambda v: -(v / list_sum(c)) * log2(v / list_sum(c)))), 0), 6) AS entropy FROM c",
    "pose_rotations": f"""{_S} SELECT vec_id, {_ld('1 + 5 * cos(x[1]) - 6 * sin(x[1]) + 8 * sin(x[1]) + 9 * cos(x[1])')} AS x, {_ld('cos(x[1]) + 3 * sin(x[1]) + 5 - 7 * sin(x[1]) + 9 * cos(x[1])')} AS y, {_ld('cos(x[1]) - 2 * sin(x[1]) + 4 * sin(x[1]) + 5 * cos(x[1]) + 9')} AS z,
 {_ld('-2 * x[3] + 3 * x[2] + 4 * x[3] - 6 * x[1] - 7 * x[2] + 8 * x[1]')} AS skewed, {_ld('x[1] + 2 * x[2] + 3 * x[3]')} AS unskewed, {_ld('x[1] * 40 + pi() - 2 * pi() * floor((x[1] * 40 + pi()) / (2 * pi())) - pi()')} AS wrapped FROM t""",
    "pose_turns": f"{_S} SELECT vec_id, round(x[1], 6) AS a0, round(x[2], 6) AS a1, round(x[3], 6) AS a2, true AS quaternion, true AS euler FROM t", "pose_inverse": f"{_S} SELECT vec_id, 34.0::DOUBLE AS unit, true AS back FROM t",
    "pose_reach": f"{_S}, p AS (SELECT vec_id, 1 + x[1] / 2 AS px, x[2] / 2 AS py FROM t), c AS (SELECT *, (px * px + py * py - 1.25) AS c FROM p) SELECT vec_id, CASE WHEN abs(c) <= 1 THEN round(px, 6) END AS x, CASE WHEN abs(c) <= 1 THEN round(py, 6) END AS y FROM c",
    "pose_chain": f"""{_S}, j AS (SELECT vec_id, x[1] AS a, x[1] + x[2] AS b FROM t) SELECT vec_id, {_ld('cos(a) + 0.5 * cos(b)')} AS end_x, {_ld('sin(a) + 0.5 * sin(b)')} AS end_y, {_ld('4 * cos(a) + 5 * sin(a) + 7 * (cos(a) + 0.5 * cos(b)) + 8 * (sin(a) + 0.5 * sin(b))')} AS places,
 {_ld('-sin(a) - 0.5 * sin(b) - sin(b) + 3 * (cos(a) + 0.5 * cos(b)) + 2 * cos(b)')} AS jacobian, {_ld('-sin(a) - 0.5 * sin(b) - sin(b) + 3 * (cos(a) + 0.5 * cos(b)) + 2 * cos(b)')} AS geometric FROM j""",
    "pose_clearance": f"""{_S}, v AS (SELECT *, list_transform(range(1, 4), lambda i: x[i + 6] - x[i + 3]) AS ab, list_transform(range(1, 4), lambda i: x[i] - x[i + 3]) AS ap FROM t),
 w AS (SELECT *, least(1, greatest(0, list_sum(list_transform(range(1, 4), lambda i: ap[i] * ab[i])) / list_sum(list_transform(ab, lambda k: k * k)))) AS s FROM v)
 SELECT vec_id, {_ld('sqrt(list_sum(list_transform(range(1, 4), lambda i: (ap[i] - s * ab[i]) ^ 2)))')} AS segment, {_ld(_c3.format(0.1, 0.2, 0.3) + ' - 0.05')} AS sphere, {_ld(f'sqrt(list_sum(list_transform({_g}, lambda k: greatest(k, 0) ^ 2))) + least(list_max({_g}), 0)')} AS box,
 {_ld('sqrt(x[1] ^ 2 + x[2] ^ 2 + (x[3] - least(1, greatest(0, x[3]))) ^ 2) - 0.1')} AS capsule, {_ld(f'greatest(0, list_max({_g}))')} AS violation, list_max({_g}) <= 0 AS inside, {_ld(_d(_cl))} AS clipped FROM w""",
    "pose_motion": f"{_S} SELECT vec_id, {_ld(_cub('x[1] + 0.5'))} AS cubic, {_ld(_qui('x[1] + 0.5'))} AS quintic, {_ld(_d('list_transform(range(1, 4), lambda i: x[i] + (x[i + 3] - x[i]) * 0.216)'))} AS there, {_ld(_d('list_transform(range(1, 4), lambda i: x[i] + (x[i + 3] - x[i]) * 0.25)'))} AS \"between\" FROM t",
}
