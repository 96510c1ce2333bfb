"""Trains the block labeller: ``python -m sealstone.llm.html_train``.

Pages are made from random layouts whose main text is known by construction: the article with headings,
paragraphs, lists, quotes and tables, among menus, headers, footers, sidebars, notices, adverts, forms
and reader comments, inside the article too. Training is plain back-propagation through time with Adam.
"""

from __future__ import annotations

import random

import numpy as np

from sealstone.llm.html import DIM, HIDDEN, WEIGHTS, Labeller, blocks, features

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu ar en il on ur ther ing tion ment que keit ción eau".split()
NOISE_WORDS = "home about contact login sign up subscribe newsletter cookie cookies accept privacy policy terms copyright all rights reserved share tweet related more read next previous reply comments advertisement sponsored menu search categories tags archive follow us".split()
MAIN = ("article", 'div class="content"', 'div class="article-body"', "main", 'div id="main-content"', 'div class="post entry"', 'section class="story"', 'article class="post"', 'div class="entry-content"')
OUTSIDE = {
    "menu": ("nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'div class="breadcrumbs"'),
    "header": ("header", 'div class="header"', 'div id="masthead"', 'header class="site-header"'),
    "footer": ("footer", 'div class="footer"', 'div id="site-footer"', 'footer class="page-footer"'),
    "side": ("aside", 'div class="sidebar"', 'div class="related"', 'section class="widget"', 'aside class="sidebar"'),
    "notice": ('div class="cookie-notice"', 'div class="banner"', 'div class="popup"', 'div role="alert" class="notice"', 'div class="newsletter"'),
    "ad": ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'section class="promo"', 'div id="ad-top"'),
    "form": ("form", 'form class="search"', 'div class="login-form"'),
    "comments": ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"'),
    "share": ('div class="share"', 'div class="social"', 'ul class="tags"'),
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int, noise: float = 0.0) -> str:
        got = [self.r.choice(NOISE_WORDS) if self.r.random() < noise else self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(got)

    def sentences(self, n: int) -> str:
        """Prose, and now and then what poor pages hold: one word over and over, signs, capitals, cells."""
        odd = self.r.random()
        if odd < 0.05:
            return " ".join([self.word().capitalize()] * self.r.randint(3, 120))
        if odd < 0.08:
            return " ".join(self.word() + self.r.choice(("###", "***", "$$$", "!!", "%%%", "&&&")) for _ in range(self.r.randint(2, 60)))
        if odd < 0.10:
            return self.words(2, 40).upper()
        if odd < 0.12:
            return " | ".join(self.word() for _ in range(self.r.randint(2, 30)))
        if odd < 0.15:
            return " ".join([self.words(3, 12).capitalize() + "."] * self.r.randint(2, 12))
        return " ".join(self.words(1, 18).capitalize() + self.r.choice("...!?") for _ in range(n))

    def inside(self, spec: str, body: str) -> str:
        end = "" if self.r.random() < 0.03 else f"</{spec.split()[0]}>"
        return f"<{spec}>{body}{end}"

    def mark(self, text: str) -> str:
        """Main text carries marks, so that labels can be read off the blocks."""
        return "\x02" + text

    def paragraph(self) -> str:
        kind = self.r.random()
        size = self.r.choice((1, 1, 2, 3, 6))
        text = self.mark(self.sentences(size))
        if kind < 0.6:
            return f"<p>{text}" + self.r.choice(("</p>", "</p>", ""))
        if kind < 0.7:
            return f"<p><b>{self.mark(self.sentences(1))}<br>" + f"<p>{text}</p>"
        if kind < 0.78:
            return f"<h{self.r.randint(2, 4)}>{self.mark(self.words(1, 8))}</h{self.r.randint(2, 4)}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.mark(self.words(1, 15))}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.mark(self.words(1, 4))}</td><td>{self.mark(self.words(1, 4))}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        return f"<div>{text}</div>"

    def noise(self, kind: str) -> str:
        spec = self.r.choice(OUTSIDE[kind])
        if kind in ("menu", "share"):
            item = lambda: f'<li><a href="/{self.word()}">{self.words(1, 3, 0.4)}</a></li>'
            body = "".join(item() for _ in range(self.r.randint(1, 9)))
            return self.inside(spec, body if spec.startswith("ul") else f"<ul>{body}</ul>")
        if kind == "comments":
            one = lambda: f'<div class="comment"><span>{self.words(1, 2)}</span><p>{self.sentences(self.r.randint(1, 3))}</p></div>'
            return self.inside(spec, "".join(one() for _ in range(self.r.randint(1, 5))))
        if kind == "form":
            return self.inside(spec, f"<label>{self.words(1, 3, 0.5)}</label><input><button>{self.words(1, 2, 0.7)}</button>")
        body = self.sentences(self.r.randint(1, 3)) if self.r.random() < 0.6 else self.words(1, 12, 0.4)
        return self.inside(spec, body if self.r.random() < 0.5 else f"<p>{body}</p>")

    def page(self) -> str:
        article = [f"<h1>{self.mark(self.words(1, 10))}</h1>"] * (self.r.random() < 0.8)
        n = self.r.choice((0, 1, 2, 4, 8, 16))
        article += [self.paragraph() for _ in range(n)]
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            article.insert(self.r.randint(1, len(article)) if article else 0, self.noise(self.r.choice(("ad", "share", "side", "form", "notice", "comments"))))
        kinds = [k for k in OUTSIDE if k != "share"]
        before = [self.noise(self.r.choice(("menu", "header", "notice", "ad", "side", "form"))) for _ in range(self.r.choice((0, 1, 2, 2, 3)))]
        after = [self.noise(self.r.choice(kinds)) for _ in range(self.r.choice((0, 1, 1, 2, 3)))]
        body = "".join(before) + (self.inside(self.r.choice(MAIN), "".join(article)) if article else "") + "".join(after)
        for _ in range(self.r.choice((0, 0, 1, 2))):
            body = f"<div>{body}</div>" if self.r.random() < 0.5 else f'<div class="{self.r.choice(("wrapper", "container", "page", "row", "layout"))}">{body}</div>'
        return f"<html><head><title>{self.words(1, 6)}</title></head><body>{body}</body></html>"


def examples(maker: Maker, pages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    got = [x for x in (labelled(maker.page()) for _ in range(pages)) if len(x[1])]
    return list(zip(features([b for b, _ in got]), [y for _, y in got], strict=True))


def labelled(page: str) -> tuple[list, np.ndarray]:
    cut = blocks(page)
    y = np.array(["\x02" in t for _, t, _ in cut], np.float32)
    return [(p, t.replace("\x02", ""), a) for p, t, a in cut], y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _forward(x, live, w, u, b):
    steps, pages, _ = x.shape
    n, h, c, kept = HIDDEN, np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), []
    for t in range(steps):
        z = x[t] @ w + h @ u + b
        i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n]), np.tanh(z[:, 3 * n :])
        c2 = f * c + i * g
        th = np.tanh(c2)
        on = live[t][:, None]
        h_next = np.where(on, o * th, h)
        kept.append((h, c, i, f, o, g, th, on))
        h, c = h_next, np.where(on, c2, c)
        kept[-1] += (h,)
    return kept


def _backward(x, kept, dh_out, w, u):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN)
    dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
    for t in range(len(kept) - 1, -1, -1):
        h, c, i, f, o, g, th, on, _ = kept[t]
        d = dh + dh_out[t]
        dz_h = np.where(on, d, 0)
        dc_t = np.where(on, dc, 0) + dz_h * o * (1 - th**2)
        dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * c * f * (1 - f), dz_h * th * o * (1 - o), dc_t * i * (1 - g**2)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dh = np.where(on, dz @ u.T, d)
        dc = np.where(on, dc_t * f, dc)
    return dw, du, db


def train(pages: int = 8000, epochs: int = 8, batch: int = 32, seed: int = 1) -> dict[str, np.ndarray]:
    rng, maker = np.random.default_rng(seed), Maker(seed)
    data = examples(maker, pages)
    p = {}
    for way in "fb":
        p[f"w{way}"], p[f"u{way}"] = rng.standard_normal((DIM, 4 * HIDDEN)) * 0.15, rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2
        p[f"b{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["wo"], p["bo"] = rng.standard_normal((2 * HIDDEN, 1)) * 0.2, np.zeros(1)
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order, loss, wrong, n = rng.permutation(len(data)), 0.0, 0, 0
        for a in range(0, len(order), batch):
            group = sorted((data[i] for i in order[a : a + batch]), key=lambda d: len(d[1]))
            size = np.array([len(y) for _, y in group])
            x, y = np.zeros((size.max(), len(group), DIM)), np.zeros((size.max(), len(group)))
            for j, (fx, fy) in enumerate(group):
                x[: size[j], j], y[: size[j], j] = fx, fy
            live = np.arange(len(x))[:, None] < size
            ahead = _forward(x, live, p["wf"], p["uf"], p["bf"])
            back = _forward(x[::-1], live[::-1], p["wb"], p["ub"], p["bb"])
            h = np.concatenate([np.stack([k[-1] for k in ahead]), np.stack([k[-1] for k in back])[::-1]], axis=2)
            prob = _sigmoid((h @ p["wo"] + p["bo"])[..., 0])
            loss += -(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9) * live).sum()
            wrong, n = wrong + (((prob >= 0.5) != (y > 0)) & live).sum(), n + live.sum()
            dz = ((prob - y) * live / live.sum())[..., None]
            grad = {"wo": h.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "bo": dz.sum((0, 1))}
            dh = dz @ p["wo"].T
            grad["wf"], grad["uf"], grad["bf"] = _backward(x, ahead, dh[..., :HIDDEN], p["wf"], p["uf"])
            grad["wb"], grad["ub"], grad["bb"] = _backward(x[::-1], back, dh[::-1, :, HIDDEN:], p["wb"], p["ub"])
            step += 1
            rate = 4e-3 * (1 - epoch / epochs)
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / n:.4f}, blocks wrong {wrong / n:.4f}", flush=True)
    return {k: a.astype(np.float32) for k, a in p.items()}


def accuracy(weights: dict[str, np.ndarray], pages: int = 500, seed: int = 999) -> float:
    """Share of blocks of new pages that are labelled right."""
    maker = Maker(seed)
    data = examples(maker, pages)
    got = Labeller(weights).scores([x for x, _ in data])
    return float(np.concatenate([(s >= 0.5) == (y > 0) for s, (_, y) in zip(got, data, strict=True)]).mean())


if __name__ == "__main__":
    trained = train()
    print("held out:", accuracy(trained))
    WEIGHTS.parent.mkdir(exist_ok=True)
    np.savez_compressed(WEIGHTS, **trained)
