"""The 28 sky projections of Calabretta and Greisen (2002), and their HEALPix successors, as stages.

Forward: native (phi, theta) to plane (x, y), in degrees.  Inverse: the other
way.  What is out of a projection's domain is NaN.  Iterative inverses are
unrolled Newton steps, in stages of their own, so that they stay in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from astrolane.stages import NAN, PI, R, Stages, asind, atan2d, cosd, horner, hypot, num, sind, tand, when

D = math.radians


@dataclass
class Projection:
    code: str
    theta0: float
    forward: Callable[[str, str], Stages]  # sets _x and _y
    inverse: Callable[[str, str], Stages]  # sets _phi and _theta
    pv: dict[int, float] = field(default_factory=dict)


def _zenithal(radius: Callable[[str], str], theta: Callable[[str], str], ok: str = "true", ok_r: str = "true"):
    def forward(phi: str, th: str) -> Stages:
        return [{"_r": when(ok.replace("@", th), radius(th))}, {"_x": f"_r * {sind(phi)}", "_y": f"-_r * {cosd(phi)}"}]

    def inverse(x: str, y: str) -> Stages:
        return [{"_r": hypot(x, y)}, {"_phi": when("_r = 0", "0e0", atan2d(x, f"-({y})")), "_theta": when(ok_r, theta("_r"))}]

    return forward, inverse


def tan(pv):
    return _zenithal(lambda t: f"{num(R)} * {cosd(t)} / {sind(t)}", lambda r: atan2d(num(R), r), "@ > 0")


def stg(pv):
    return _zenithal(lambda t: f"2 * {num(R)} * {cosd(t)} / (1 + {sind(t)})", lambda r: f"90 - 2 * degrees(atan({r} / {num(2 * R)}))", "@ > -90")


def arc(pv):
    return _zenithal(lambda t: f"90 - ({t})", lambda r: f"90 - {r}")


def zea(pv):
    return _zenithal(lambda t: f"{num(2 * R)} * {sind(f'(90 - ({t})) / 2')}", lambda r: f"90 - 2 * ({asind(f'{r} / {num(2 * R)}')})")


def sin(pv):
    xi, eta = pv.get(1, 0.0), pv.get(2, 0.0)

    def forward(phi, th):
        return [
            {"_s": sind(th), "_c": cosd(th), "_sp": sind(phi), "_cp": cosd(phi)},
            {"_in": f"{num(xi)} * _c * _sp - {num(eta)} * _c * _cp + _s >= 0"},
            {"_x": when("_in", f"{num(R)} * (_c * _sp + {num(xi)} * (1 - _s))"), "_y": when("_in", f"-{num(R)} * (_c * _cp - {num(eta)} * (1 - _s))")},
        ]

    def inverse(x, y):
        if xi == 0 and eta == 0:
            return [{"_r": hypot(x, y)}, {"_phi": when("_r = 0", "0e0", atan2d(x, f"-({y})")), "_theta": when(f"_r <= {num(R)}", f"degrees(acos(_r / {num(R)}))")}]
        # with u = 1 - sin(theta): |(X, Y) - u (xi, eta)|^2 = 1 - (1 - u)^2
        return [
            {"_p": f"({x}) / {num(R)}", "_q": f"({y}) / {num(R)}"},
            {"_b": f"{num(xi)} * _p + {num(eta)} * _q + 1", "_e": "_p * _p + _q * _q"},
            {"_disc": f"_b * _b - {num(xi * xi + eta * eta + 1)} * _e"},
            {"_u": when("_disc >= 0", "_e / (_b + sqrt(abs(_disc)))")},
            {"_phi": when("_u is not null and _u = 0", "0e0", atan2d(f"_p - {num(xi)} * _u", f"-(_q - {num(eta)} * _u)")), "_theta": when("_u >= 0 and _u <= 2", f"{asind('1 - _u')}")},
            {"_phi": when("isnan(_theta)", NAN, "_phi")},
        ]

    return forward, inverse


def zpn(pv):
    c = [pv.get(k, 0.0) for k in range(21)]
    while len(c) > 1 and c[-1] == 0:
        c.pop()
    dc = [k * v for k, v in enumerate(c)][1:] or [0.0]

    def forward(phi, th):
        return [{"_z": f"radians(90 - ({th}))"}, {"_r": f"{num(R)} * {horner('_z', c)}"}, {"_x": f"_r * {sind(phi)}", "_y": f"-_r * {cosd(phi)}"}]

    def inverse(x, y):
        first = {"_z": f"_rho / {num(c[1])}" if len(c) > 1 and c[1] else "_rho"}
        out = [{"_rho": f"{hypot(x, y)} / {num(R)}"}, first]
        for _ in range(12):
            out += [{"_f": f"{horner('_z', c)} - _rho", "_d": horner("_z", dc)}, {"_z": when("abs(_d) > 1e-14", f"least({num(PI)}, greatest(0e0, _z - _f / _d))", "_z")}]
        return [*out, {"_theta": when(f"abs({horner('_z', c)} - _rho) < 1e-11", "90 - degrees(_z)"), "_phi": when("_rho = 0", "0e0", atan2d(x, f"-({y})"))}]

    return forward, inverse


def azp(pv):
    mu, gamma = pv.get(1, 0.0), pv.get(2, 0.0)
    tg, cg, sg = math.tan(D(gamma)), math.cos(D(gamma)), math.sin(D(gamma))

    def forward(phi, th):
        fold = f"and ({th}) >= {num(math.degrees(math.asin(-1 / mu)))}" if abs(mu) > 1 else ""
        return [
            {"_den": f"{num(mu)} + {sind(th)} + {cosd(th)} * {cosd(phi)} * {num(tg)}"},
            {"_r": when(f"_den > 0 {fold}", f"{num(R * (mu + 1))} * {cosd(th)} / _den")},
            {"_x": f"_r * {sind(phi)}", "_y": f"-_r * {cosd(phi)} * {num(1 / cg)}"},
        ]

    def inverse(x, y):
        return [
            {"_yc": f"({y}) * {num(cg)}"},
            {"_r": hypot(x, "_yc")},
            {"_phi": when("_r = 0", "0e0", atan2d(x, "-_yc")), "_rho": f"_r / ({num(R * (mu + 1))} + ({y}) * {num(sg)})"},
            {"_psi": atan2d("1e0", "_rho"), "_t": f"_rho * {num(mu)} / sqrt(_rho * _rho + 1)"},
            {"_w": when("abs(_t) <= 1", "degrees(asin(greatest(-1e0, least(1e0, _t))))")},
            {"_a": "_psi - _w", "_b": "_psi + _w + 180"},
            {"_b": "_b - 360 * floor((_b + 90) / 360)"},
            {"_theta": when("isnan(_w)", NAN, when("_b <= 90 and abs(_b - 90) < abs(_a - 90)", "_b", "_a"))},
        ]

    return forward, inverse


def szp(pv):
    mu, pc, tc = pv.get(1, 0.0), pv.get(2, 0.0), pv.get(3, 90.0)
    xp, yp, zp = -mu * math.cos(D(tc)) * math.sin(D(pc)), mu * math.cos(D(tc)) * math.cos(D(pc)), mu * math.sin(D(tc)) + 1

    def forward(phi, th):
        # seen from (xp, yp, zp) at the centre's height: the side of the sphere that faces that point
        return [
            {"_u": f"1 - {sind(th)}", "_l": f"{cosd(th)} * {sind(phi)}", "_m": f"{cosd(th)} * {cosd(phi)}"},
            {"_den": f"{num(zp)} - _u", "_facing": f"{num(xp)} * _l - {num(yp)} * _m + {num(zp - 1)} * (1 - _u)"},
            {"_ok": "abs(_den) > 1e-12 and _den > 0" + (" and _facing > -1" if abs(mu) > 1 else "")},
            {"_x": when("_ok", f"{num(R)} * ({num(zp)} * _l - {num(xp)} * _u) / _den"), "_y": when("_ok", f"-{num(R)} * ({num(zp)} * _m + {num(yp)} * _u) / _den")},
        ]

    def inverse(x, y):
        return [
            {"_p": f"({x}) / {num(R)}", "_q": f"({y}) / {num(R)}"},
            {"_g": f"(_p - {num(xp)}) / {num(zp)}", "_h": f"(_q - {num(yp)}) / {num(zp)}"},
            {"_a": "_g * _g + _h * _h + 1", "_b": "_g * _p + _h * _q + 1", "_e": "_p * _p + _q * _q"},
            {"_disc": "_b * _b - _a * _e"},
            {"_u": when("_disc >= 0", "_e / (_b + sqrt(abs(_disc)))")},
            {"_theta": when("_u >= 0 and _u <= 2", asind("1 - _u")), "_phi": when("_u = 0", "0e0", atan2d("_p - _g * _u", "-(_q - _h * _u)"))},
        ]

    return forward, inverse


def air(pv):
    tb = pv.get(1, 90.0)
    xb = D((90 - tb) / 2)
    cb = -0.5 if xb < 1e-4 else math.log(math.cos(xb)) / math.tan(xb) ** 2

    def radius(z: str) -> str:
        return when(f"{z} < 1e-8", f"{num(-2 * R * (cb - 0.5))} * {z}", f"{num(-2 * R)} * (ln(greatest(cos({z}), 1e-300)) / tan(greatest({z}, 1e-12)) + tan({z}) * {num(cb)})")

    def forward(phi, th):
        return [{"_z": f"radians((90 - ({th})) / 2)"}, {"_r": when("_z < 1.5707", radius("_z"))}, {"_x": f"_r * {sind(phi)}", "_y": f"-_r * {cosd(phi)}"}]

    def inverse(x, y):
        out: Stages = [{"_rho": f"{hypot(x, y)}"}, {"_z": f"least(1.5, _rho / {num(-2 * R * (cb - 0.5))})"}]
        for _ in range(16):  # d r / d z by the product rule
            out += [
                {"_f": f"({radius('_z')}) - _rho", "_d": when("_z < 1e-8", num(-2 * R * (cb - 0.5)), f"{num(-2 * R)} * (-1 - ln(greatest(cos(_z), 1e-300)) / pow(greatest(sin(_z), 1e-12), 2) + {num(cb)} / pow(cos(_z), 2))")},
                {"_z": when("abs(_d) > 1e-12", "least(1.57, greatest(0e0, _z - _f / _d))", "_z")},
            ]
        return [*out, {"_theta": when(f"abs(({radius('_z')}) - _rho) < 1e-9", "90 - 2 * degrees(_z)"), "_phi": when("_rho = 0", "0e0", atan2d(x, f"-({y})"))}]

    return forward, inverse


def _plane(fx: str, fy: str, gp: str, gt: str, ok: str = "true", iok: str = "true"):
    """Closed forms over {p}, {t} and {x}, {y}."""

    def forward(phi, th):
        f = lambda s: s.replace("{p}", f"({phi})").replace("{t}", f"({th})")
        return [{"_x": when(f(ok), f(fx)), "_y": when(f(ok), f(fy))}]

    def inverse(x, y):
        f = lambda s: s.replace("{x}", f"({x})").replace("{y}", f"({y})")
        return [{"_theta": when(f(iok), f(gt))}, {"_phi": when("isnan(_theta)", NAN, f(gp))}]

    return forward, inverse


def car(pv):
    return _plane("{p}", "{t}", "{x}", "{y}")


def cea(pv):
    la = pv.get(1, 1.0)
    return _plane("{p}", f"{num(R / la)} * {sind('{t}')}", "{x}", asind(f"{num(la / R)} * {{y}}"))


def mer(pv):
    return _plane("{p}", f"{num(R)} * ln({tand('(90 + {t}) / 2')})", "{x}", f"2 * degrees(atan(exp({{y}} / {num(R)}))) - 90", "abs({t}) < 90")


def cyp(pv):
    mu, la = pv.get(1, 1.0), pv.get(2, 1 / math.sqrt(2))
    eta = f"({{y}} / {num(R * (mu + la))})"
    return _plane(f"{num(la)} * {{p}}", f"{num(R * (mu + la))} * {sind('{t}')} / ({num(mu)} + {cosd('{t}')})", f"{{x}} / {num(la)}", f"{atan2d(eta, '1e0')} + ({asind(f'{eta} * {num(mu)} / sqrt({eta} * {eta} + 1)')})", f"{num(mu)} + {cosd('{t}')} <> 0")


def sfl(pv):
    return _plane(f"{{p}} * {cosd('{t}')}", "{t}", when(f"abs({cosd('{y}')}) < 1e-13", "0e0", f"{{x}} / {cosd('{y}')}"), "{y}", "true", "abs({y}) <= 90")


def par(pv):
    return _plane(f"{{p}} * (2 * {cosd('2 * {t} / 3')} - 1)", f"180 * {sind('{t} / 3')}", when("abs(1 - 4 * pow({y} / 180, 2)) < 1e-13", "0e0", "{x} / (1 - 4 * pow({y} / 180, 2))"), f"3 * ({asind('{y} / 180')})", "true", "abs({y}) <= 90.0000001")


def mol(pv):
    s = math.sqrt(2)

    def forward(phi, th):
        out: Stages = [{"_v": f"{num(PI)} * {sind(th)}"}, {"_g": f"radians({th})"}]
        for _ in range(24):  # 2g = gamma, 2 gamma' + sin(2 gamma') = v; slow next to the poles, where the root is nearly triple
            out += [{"_d": "2 + 2 * cos(2 * _g)", "_f": "2 * _g + sin(2 * _g) - _v"}, {"_g": when("_d > 1e-10", f"greatest({num(-PI / 2)}, least({num(PI / 2)}, _g - _f / _d))", "_g")}]
        return [*out, {"_x": f"{num(2 * s / PI)} * ({phi}) * cos(_g)", "_y": f"{num(s * R)} * sin(_g)"}]

    def inverse(x, y):
        return [
            {"_w": f"({y}) / {num(s * R)}"},
            {"_c": when("abs(_w) <= 1", "sqrt(abs(1 - _w * _w))")},
            {"_phi": when("_c < 1e-9", "0e0", f"{num(PI / (2 * s))} * ({x}) / greatest(_c, 1e-12)"), "_theta": asind(f"2 * asin(greatest(-1e0, least(1e0, _w))) / {num(PI)} + ({y}) * _c / {num(R * s * PI / 2)}")},
            {"_theta": when("isnan(_c)", NAN, "_theta")},
        ]

    return forward, inverse


def mollweide_fast(phi: str, th: str, x: str, y: str) -> Stages:
    """Mollweide's plane in three Newton steps; what mol() gives otherwise.

    With e = pi - 2 |gamma| the equation is e - sin e = w, whose root has the
    series of c = (6 w)^(1/3); that is the start, and near a pole the root itself.
    """
    out: Stages = [{"_w": f"{num(2 * PI)} * pow(sin(radians(90 - abs({th})) / 2), 2)"}, {"_c": "pow(6 * _w, 1e0 / 3)"}, {"_e": horner("_c * _c", [1.0, 1 / 60, 1 / 1400, 1 / 25200, 43 / 17248000])}, {"_e": f"least({num(PI)}, _c * _e)"}]
    for _ in range(3):
        out.append({"_e": when("_c < 0.3", "_e", "_e - (_e - sin(_e) - _w) / (1 - cos(_e))")})
    s = math.sqrt(2)
    return [*out, {x: f"{num(2 * s / PI)} * ({phi}) * sin(_e / 2)", y: f"{num(s * R)} * sign({th}) * cos(_e / 2)"}]


def ait(pv):
    def forward(phi, th):
        return [{"_g": f"{num(R)} * sqrt(2 / (1 + {cosd(th)} * {cosd(f'({phi}) / 2')}))"}, {"_x": f"2 * _g * {cosd(th)} * {sind(f'({phi}) / 2')}", "_y": f"_g * {sind(th)}"}]

    def inverse(x, y):
        return [{"_s": f"1 - pow(({x}) / {num(4 * R)}, 2) - pow(({y}) / {num(2 * R)}, 2)"}, {"_z": when("_s >= 0.5 - 1e-12", "sqrt(abs(_s))")}, {"_phi": f"2 * {atan2d(f'_z * ({x}) / {num(2 * R)}', '2 * _z * _z - 1')}", "_theta": asind(f"({y}) * _z / {num(R)}")}]

    return forward, inverse


def _conic(c: float, y0: float, sign: float, radius: Callable[[str], str], theta: Callable[[str], str], ok: str = "true"):
    def forward(phi, th):
        return [{"_r": when(ok.replace("@", f"({th})"), radius(f"({th})"))}, {"_x": f"_r * {sind(f'{num(c)} * ({phi})')}", "_y": f"{num(y0)} - _r * {cosd(f'{num(c)} * ({phi})')}"}]

    def inverse(x, y):
        return [{"_dy": f"{num(y0)} - ({y})"}, {"_r": f"{num(sign)} * {hypot(x, '_dy')}"}, {"_phi": when("_r = 0", "0e0", f"{atan2d(f'{num(sign)} * ({x})', f'{num(sign)} * _dy')} / {num(c)}"), "_theta": theta("_r")}]

    return forward, inverse


def _angles(pv):
    ta, eta = pv.get(1, 45.0), pv.get(2, 0.0)
    return ta, eta, math.copysign(1.0, ta)


def cop(pv):
    ta, eta, sign = _angles(pv)
    k, cot = R * math.cos(D(eta)), 1 / math.tan(D(ta))
    return _conic(math.sin(D(ta)), k * cot, sign, lambda t: f"{num(k)} * ({num(cot)} - {tand(f'{t} - {num(ta)}')})", lambda r: f"{num(ta)} + degrees(atan({num(cot)} - {r} / {num(k)}))", f"abs(@ - {num(ta)}) < 90")


def coe(pv):
    ta, eta, sign = _angles(pv)
    s1, s2 = math.sin(D(ta - eta)), math.sin(D(ta + eta))
    g = s1 + s2
    k = 2 * R / g
    return _conic(g / 2, k * math.sqrt(1 + s1 * s2 - g * math.sin(D(ta))), sign, lambda t: f"{num(k)} * sqrt(greatest(0e0, {num(1 + s1 * s2)} - {num(g)} * {sind(t)}))", lambda r: asind(f"({num(1 + s1 * s2)} - pow({r} / {num(k)}, 2)) / {num(g)}"))


def cod(pv):
    ta, eta, sign = _angles(pv)
    c = math.sin(D(ta)) * (math.sin(D(eta)) / D(eta) if eta else 1.0)
    y0 = (eta / math.tan(D(eta)) if eta else R) / math.tan(D(ta))
    return _conic(c, y0, sign, lambda t: f"{num(ta + y0)} - {t}", lambda r: f"{num(ta + y0)} - {r}")


def coo(pv):
    ta, eta, sign = _angles(pv)
    t1, t2 = ta - eta, ta + eta
    half = lambda t: math.tan(D((90 - t) / 2))
    c = math.log(math.cos(D(t2)) / math.cos(D(t1))) / math.log(half(t2) / half(t1)) if eta else math.sin(D(ta))
    psi = R * math.cos(D(t1)) / (c * half(t1) ** c)
    return _conic(c, psi * half(ta) ** c, sign, lambda t: f"{num(psi)} * pow({tand(f'(90 - {t}) / 2')}, {num(c)})", lambda r: when(f"{r} / {num(psi)} > 0", f"90 - 2 * degrees(atan(pow(abs({r} / {num(psi)}), {num(1 / c)})))", when(f"{r} = 0", num(90 * sign))), "@ > -90")


def bon(pv):
    t1 = pv.get(1, 45.0)
    sign, y0 = math.copysign(1.0, t1), t1 + R / math.tan(D(t1))

    def forward(phi, th):
        return [{"_r": f"{num(y0)} - ({th})"}, {"_a": when("_r = 0", "0e0", f"{num(R)} * ({phi}) * {cosd(th)} / _r")}, {"_x": f"_r * {sind('_a')}", "_y": f"{num(y0)} - _r * {cosd('_a')}"}]

    def inverse(x, y):
        return [{"_dy": f"{num(y0)} - ({y})"}, {"_r": f"{num(sign)} * {hypot(x, '_dy')}"}, {"_a": atan2d(f"{num(sign)} * ({x})", f"{num(sign)} * _dy"), "_theta": f"{num(y0)} - _r"}, {"_phi": when(f"abs({cosd('_theta')}) < 1e-12", "0e0", f"_a * _r / ({num(R)} * {cosd('_theta')})")}]

    return forward, inverse


def pco(pv):
    def forward(phi, th):
        return [
            {"_s": sind(th), "_cot": when(f"abs({th}) < 1e-9", "0e0", f"{cosd(th)} / {sind(th)}")},
            {"_a": f"({phi}) * _s"},
            {"_x": when(f"abs({th}) < 1e-9", f"{phi}", f"{num(R)} * _cot * {sind('_a')}"), "_y": when(f"abs({th}) < 1e-9", f"{th}", f"({th}) + {num(R)} * _cot * (1 - {cosd('_a')})")},
        ]

    def inverse(x, y):
        # with d = y - theta: x^2 + d^2 - 2 R d cot(theta) = 0, theta between 0 and y
        out: Stages = [{"_lo": "0e0", "_hi": f"abs({y})", "_ax": f"abs({x})"}, {"_theta": "_hi"}]
        for _ in range(40):
            out += [
                {"_th": "case when _lo = 0 and _hi > 0 then _hi / 2 else (_lo + _hi) / 2 end"},
                {"_g": when("_th < 1e-12", "-1e0", f"_ax * _ax + pow(abs({y}) - _th, 2) - {num(2 * R)} * (abs({y}) - _th) * {cosd('_th')} / greatest({sind('_th')}, 1e-15)")},
                {"_hi": "case when _g >= 0 then _th else _hi end", "_lo": "case when _g >= 0 then _lo else _th end"},
            ]
        return [
            *out,
            {"_th": "(_lo + _hi) / 2"},
            {"_theta": when(f"abs({y}) < 1e-10", "0e0", f"sign({y}) * _th")},
            {"_a": atan2d(f"_ax * {sind('_th')} / greatest({cosd('_th')}, 1e-15)", f"{num(R)} - (abs({y}) - _th) * {sind('_th')} / greatest({cosd('_th')}, 1e-15)")},
            {"_phi": when("_th < 1e-10", f"{x}", f"sign({x}) * _a / greatest({sind('_th')}, 1e-15)")},
        ]

    return forward, inverse


def _face(phi: str, th: str) -> Stages:
    """Direction cosines, the cube's face, and (xi, eta, zeta) there."""
    pick = lambda a, b, c, d, e, f: f"case _face when 0 then {a} when 1 then {b} when 2 then {c} when 3 then {d} when 4 then {e} else {f} end"
    return [
        {"_l": f"{cosd(th)} * {cosd(phi)}", "_m": f"{cosd(th)} * {sind(phi)}", "_n": sind(th)},
        {"_zeta": "greatest(_n, _l, _m, -_l, -_m, -_n)"},
        {"_face": "case when _zeta = _n then 0 when _zeta = _l then 1 when _zeta = _m then 2 when _zeta = -_l then 3 when _zeta = -_m then 4 else 5 end"},
        {"_xi": pick("_m", "_m", "-_l", "-_m", "_l", "_m"), "_eta": pick("-_l", "_n", "_n", "_n", "_n", "_l"), "_x0": pick("0", "0", "2", "4", "6", "0"), "_y0": pick("2", "0", "0", "0", "0", "-2")},
    ]


def _unface(x: str, y: str) -> Stages:
    """The face under a plane point, and its place (u, v) there, -1 to 1."""
    return [
        {"_xf": f"({x}) / 45", "_yf": f"({y}) / 45"},
        {"_xf": "case when _xf < -1 then _xf + 8 else _xf end"},
        {"_face": "case when _yf > 1 then 0 when _yf < -1 then 5 when _xf > 5 then 4 when _xf > 3 then 3 when _xf > 1 then 2 else 1 end"},
        {"_u": "case _face when 4 then _xf - 6 when 3 then _xf - 4 when 2 then _xf - 2 else _xf end", "_v": "case _face when 0 then _yf - 2 when 5 then _yf + 2 else _yf end"},
        {"_on": "abs(_u) <= 1.0000000001 and abs(_v) <= 1.0000000001"},
    ]


def _sphere() -> Stages:
    """From the face and (xi, eta, zeta) back to native coordinates."""
    pick = lambda a, b, c, d, e, f: f"case _face when 0 then {a} when 1 then {b} when 2 then {c} when 3 then {d} when 4 then {e} else {f} end"
    return [
        {"_l": pick("-_eta", "_zeta", "-_xi", "-_zeta", "_xi", "_eta"), "_m": pick("_xi", "_xi", "_zeta", "-_xi", "-_zeta", "_xi"), "_n": pick("_zeta", "_eta", "_eta", "_eta", "_eta", "-_zeta")},
        {"_phi": when("_on", when("_l = 0 and _m = 0", "0e0", atan2d("_m", "_l"))), "_theta": when("_on", atan2d("_n", "sqrt(_l * _l + _m * _m)"))},
    ]


def tsc(pv):
    def forward(phi, th):
        return [*_face(phi, th), {"_x": "45 * (_x0 + _xi / _zeta)", "_y": "45 * (_y0 + _eta / _zeta)"}]

    def inverse(x, y):
        return [*_unface(x, y), {"_zeta": "1 / sqrt(1 + _u * _u + _v * _v)"}, {"_xi": "_u * _zeta", "_eta": "_v * _zeta"}, *_sphere()]

    return forward, inverse


#: The COBE cube's polynomials (Chan and O'Neill 1975).
CSC_GSTAR, CSC_M, CSC_GAMMA, CSC_OMEGA1 = 1.37484847732, 0.004869491981, -0.13161671474, -0.159596235474
CSC_D0, CSC_D1 = 0.0759196200467, -0.0217762490699
CSC_C = {(0, 0): 0.141189631152, (1, 0): 0.0809701286525, (0, 1): -0.281528535557, (1, 1): 0.15384112876, (2, 0): -0.178251207466, (0, 2): 0.106959469314}
CSC_P = [
    [-0.27292696, -0.07629969, -0.22797056, 0.54852384, -0.62930065, 0.25795794, 0.02584375],
    [-0.02819452, -0.01471565, 0.48051512, -1.74114454, 1.71547508, -0.53022337],
    [0.27058160, -0.56800938, 0.30803317, 0.98938102, -0.83180469],
    [-0.60441560, 1.50880086, -0.93678576, 0.08693841],
    [0.93412077, -1.41601920, 0.33887446],
    [-0.63915306, 0.52032238],
    [0.14381585],
]


def csc(pv):
    def fwd(a: str, b: str) -> str:
        a2, b2 = f"({a} * {a})", f"({b} * {b})"
        poly = " + ".join(f"{num(v)} * pow({a2}, {i}) * pow({b2}, {j})" for (i, j), v in CSC_C.items())
        return f"{a} * ({num(CSC_GSTAR)} + {a2} * {num(1 - CSC_GSTAR)} + (1 - {a2}) * ({b2} * ({num(CSC_GAMMA)} + {num(CSC_M - CSC_GAMMA)} * {a2} + (1 - {b2}) * ({poly})) + {a2} * ({num(CSC_OMEGA1)} - (1 - {a2}) * ({num(CSC_D0)} + {num(CSC_D1)} * {a2}))))"

    def inv(a: str, b: str) -> str:
        a2, b2 = f"({a} * {a})", f"({b} * {b})"
        poly = horner(b2, [0.0])
        rows = [horner(a2, row) for row in CSC_P]
        poly = rows[-1]
        for r in reversed(rows[:-1]):
            poly = f"({r} + {b2} * {poly})"
        return f"{a} + {a} * (1 - {a2}) * {poly}"

    def forward(phi, th):
        return [*_face(phi, th), {"_a": "_xi / _zeta", "_b": "_eta / _zeta"}, {"_x": f"45 * (_x0 + {fwd('_a', '_b')})", "_y": f"45 * (_y0 + {fwd('_b', '_a')})"}]

    def inverse(x, y):
        return [*_unface(x, y), {"_a": inv("_u", "_v"), "_b": inv("_v", "_u")}, {"_zeta": "1 / sqrt(1 + _a * _a + _b * _b)"}, {"_xi": "_a * _zeta", "_eta": "_b * _zeta"}, *_sphere()]

    return forward, inverse


def qsc(pv):
    h = 1 / math.sqrt(2)

    def forward(phi, th):
        return [
            *_face(phi, th),
            {"_flip": "abs(_xi) < abs(_eta)"},
            {"_big": "case when _flip then _eta else _xi end", "_small": "case when _flip then _xi else _eta end"},
            {"_w": when("_big = 0", "0e0", "_small / _big")},
            {"_s": "sqrt((_xi * _xi + _eta * _eta) / (1 + _zeta))"},  # sqrt(1 - zeta) without its cancellation
            {"_a": "case when _big < 0 then -1 else 1 end * _s / sqrt(1 - 1 / sqrt(2 + _w * _w))"},
            {"_b": "_a / 15 * (degrees(atan(_w)) - degrees(asin(_w / sqrt(2 * (1 + _w * _w)))))"},
            {"_x": "45 * (_x0 + case when _flip then _b else _a end)", "_y": "45 * (_y0 + case when _flip then _a else _b end)"},
        ]

    def inverse(x, y):
        return [
            *_unface(x, y),
            {"_flip": "abs(_u) < abs(_v)"},
            {"_big": "case when _flip then _v else _u end", "_small": "case when _flip then _u else _v end"},
            {"_t": when("_big = 0", "0e0", "15 * _small / _big")},
            {"_w": f"{sind('_t')} / ({cosd('_t')} - {num(h)})"},
            {"_d": "_big * _big * (1 - 1 / sqrt(2 + _w * _w))"},  # 1 - zeta
            {"_zeta": "1 - _d"},
            {"_p": "case when _big < 0 then -1 else 1 end * sqrt(greatest(0e0, _d * (2 - _d) / (1 + _w * _w)))"},
            {"_xi": "case when _flip then _w * _p else _p end", "_eta": "case when _flip then _p else _w * _p end"},
            *_sphere(),
        ]

    return forward, inverse


def hpx(pv):
    h, k = pv.get(1, 0) or 4.0, pv.get(2, 0) or 3.0
    odd = int(round(k)) % 2 == 1

    def centre(p: str, north: str) -> str:
        one = f"-180 + (2 * floor((({p}) + 180) * {num(h / 360)}) + 1) * {num(180 / h)}"
        return one if odd else f"case when {north} then {one} else -180 + 2 * floor((({p}) + 180) * {num(h / 360)} + 0.5) * {num(180 / h)} end"

    def forward(phi, th):
        return [
            {"_s": sind(th)},
            {"_sig": f"sqrt(greatest(0e0, {num(k)} * (1 - abs(_s))))", "_pc": centre(phi, f"({th}) > 0"), "_eq": f"abs(_s) <= {num((k - 1) / k)}"},
            {"_x": f"case when _eq then ({phi}) else _pc + (({phi}) - _pc) * _sig end", "_y": f"case when _eq then {num(90 * k / h)} * _s else sign({th}) * {num(180 / h)} * ({num((k + 1) / 2)} - _sig) end"},
        ]

    def inverse(x, y):
        return [
            {"_eq": f"abs({y}) <= {num(90 * (k - 1) / h)}", "_sig": f"{num((k + 1) / 2)} - abs({y}) * {num(h / 180)}", "_xc": centre(x, f"({y}) > 0")},
            {"_phi": f"case when _eq then ({x}) when _sig > 1e-12 then _xc + (({x}) - _xc) / _sig when _sig > -1e-9 then _xc else {NAN} end", "_theta": f"case when _eq then {asind(f'({y}) * {num(h / (90 * k))}')} when _sig > -1e-9 then sign({y}) * ({asind(f'1 - _sig * _sig / {num(k)}')}) else {NAN} end"},
            {"_phi": when(f"not _eq and abs(_phi - _xc) > {num(180 / h)} + 1e-9", NAN, "_phi")},
        ]

    return forward, inverse


def xph(pv):
    w = num(math.sqrt(0.5))

    def forward(phi, th):
        return [
            {"_chi": f"({phi}) - 360 * floor((({phi}) + 180) / 360) + 180"},  # facet and place in it from one rounded sum
            {"_psi": "_chi - 90 * floor(_chi / 90)", "_s": sind(th)},
            {"_sig": f"case when ({th}) < 90 then sqrt(greatest(0e0, 3 * (1 - abs(_s)))) else 0e0 end", "_eq": "abs(_s) <= 2 / 3e0"},
            {"_a": "case when _eq then _psi else 45 + (_psi - 45) * _sig end - 45", "_b": f"case when _eq then 67.5 * _s when ({th}) < 0 then -45 * (2 - _sig) else 45 * (2 - _sig) end - 90"},
            {"_x": f"{w} * case when _chi < 90 then -_a + _b when _chi < 180 then _a + _b when _chi < 270 then _a - _b else -_a - _b end", "_y": f"{w} * case when _chi < 90 then -_a - _b when _chi < 180 then -_a + _b when _chi < 270 then _a + _b else _a - _b end"},
        ]

    def inverse(x, y):
        return [
            {"_p": f"({x}) * {w}", "_q": f"({y}) * {w}"},
            {"_quad": "case when _p <= 0 and _q > 0 then -180 when _p < 0 and _q <= 0 then -90 when _p >= 0 and _q < 0 then 0 else 90 end"},
            {"_a": "case _quad when -180 then -_p - _q when -90 then _p - _q when 0 then _p + _q else -_p + _q end", "_b": "case _quad when -180 then _p - _q when -90 then _p + _q when 0 then -_p + _q else -_p - _q end"},
            {"_xi": "_a + 45", "_eta": "_b + 90"},
            {"_ae": "abs(_eta)"},
            {"_sig": "(90 - _ae) / 45"},
            {
                "_phi": f"case when _ae > 90 + 1e-9 then {NAN} when _ae <= 45 then _quad + _xi when _p = 0 then case when _q <= 0 then 0e0 else 180e0 end when _q = 0 then case when _p < 0 then -90e0 else 90e0 end when _sig > 1e-12 then _quad + 45 + _a / _sig else _quad + 45e0 end",
                "_theta": f"case when _ae > 90 + 1e-9 then {NAN} when _ae <= 45 then {asind('_eta / 67.5')} else sign(_eta) * case when _sig < 1e-4 then 90 - _sig * {num(R * math.sqrt(2 / 3))} else {asind('1 - _sig * _sig / 3')} end end",
            },
        ]

    return forward, inverse


_ALL = {"AIR": air, "AIT": ait, "ARC": arc, "AZP": azp, "BON": bon, "CAR": car, "CEA": cea, "COD": cod, "COE": coe, "COO": coo, "COP": cop, "CSC": csc, "CYP": cyp, "HPX": hpx, "MER": mer, "MOL": mol, "PAR": par, "PCO": pco, "QSC": qsc, "SFL": sfl, "SIN": sin, "STG": stg, "SZP": szp, "TAN": tan, "TSC": tsc, "XPH": xph, "ZEA": zea, "ZPN": zpn}
CODES = tuple(_ALL)
_ZENITHAL = {"AZP", "SZP", "TAN", "STG", "SIN", "ARC", "ZPN", "ZEA", "AIR", "XPH"}


def projection(code: str, pv: dict[int, float] | None = None) -> Projection:
    """The projection of a three-letter code, in either case, with parameters PVi_m of the latitude axis."""
    code, pv = code.upper(), dict(pv or {})
    if code in ("TPV", "TNX", "ZPX"):
        code = "ZPN" if code == "ZPX" else "TAN"
    if code not in _ALL:
        raise ValueError(f"no projection {code!r}")
    if code in ("COP", "COE", "COD", "COO", "BON") and not pv.get(1):
        raise ValueError(f"{code} needs PVi_1, not 0")
    if code == "CEA" and not 0 < pv.get(1, 1.0) <= 1:
        raise ValueError("CEA needs PVi_1 in (0, 1]")
    forward, inverse = _ALL[code](pv)
    theta0 = 90.0 if code in _ZENITHAL else pv[1] if code in ("COP", "COE", "COD", "COO") else 0.0
    return Projection(code, theta0, forward, inverse, pv)
