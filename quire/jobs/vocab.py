"""Small vocabularies of web pages: fixed values."""

KNOWN = ("a", "article", "b", "body", "br", "div", "footer", "h1", "h2", "h3", "head", "html", "li", "link", "meta", "nav", "ol", "p", "title", "ul")
DEPRECATED = ("b", "center", "font", "i", "tt")
BLOCKS = ("article", "div", "footer", "h1", "h2", "h3", "li", "nav", "ol", "p", "ul")
