"""Own small inputs for golden tests."""

SHEET = """<!DOCTYPE html><html><head><title>Ignored</title>
<meta name="keywords" content="Tokens, , Sessions "></head>
<body><nav><a href="cheatsheets/Other_Cheat_Sheet.html">Other</a></nav>
<article>
<h1>Token Handling Cheat Sheet¶</h1>
<h2>Introduction</h2><p>Tokens prove <b>who</b> calls.</p><p>Keep them short lived.</p>
<h2>Navigation</h2><p>Skip me.</p>
<h2>Injection Attack <a href="#x">¶</a></h2>
<p>Attackers send severe payloads and exploit the parser in many different ways.</p>
<p>Warning: never trust input.</p>
<p>Tip: validate early.</p>
<pre>  select 1;  </pre>
<h3>Details</h3><p>Deep text.</p><ul><li>one</li><li>two</li></ul>
<h3>Empty</h3>
<h2>Plain notes</h2><div>Nothing here.<h2>Nested</h2><p>inner</p></div><p>After nested.</p>
<h2>Contributors</h2><ul><li>Ada</li><li>Bo <i>B</i></li></ul>
<a href="../cheatsheets/Access_Control_Cheat_Sheet.html">ac</a>
<a href="/cheatsheets/Other_Cheat_Sheet.html#top">again</a>
</article></body></html>"""

LINKING_HEADING = """<html><body><h2>About <a href="#a">x</a></h2><p>not this</p>
<h3>Overview</h3><h3>Summary here</h3><p>chosen</p><ul><li>a</li></ul><hr><p>late</p></body></html>"""

PLAIN = "<html><body><p>first<p>second<div><p>third</p></div><p>fourth</body></html>"

INDEX = """<html><body><nav>
<a href="cheatsheets/Zeta_Auth_Cheat_Sheet.html">Zeta Auth Cheat Sheet</a>
<a href="cheatsheets/SQL_Cheat_Sheet.html">SQL</a>
<a href="cheatsheets/SQL_Cheat_Sheet.html">SQL over api</a>
<a href="cheatsheets/Empty_Cheat_Sheet.html"> </a>
<a href="about.html">About</a></nav>
<article><p><a href="cheatsheets/SQL_Cheat_Sheet.html">SQL</a><img alt="Java "><img alt=""></p>
<p><a href="cheatsheets/SQL_Cheat_Sheet.html">SQL</a><span><img alt="Go"><img alt="Rust"></span></p>
<p><a href="cheatsheets/SQL_Cheat_Sheet.html">SQL</a></p></article>
<p><a href="cheatsheets/Zeta_Auth_Cheat_Sheet.html">z</a><img alt="Outside"></p></body></html>"""

NUMBERED_MARKDOWN = """intro
# A01: Broken things
First line.
Impact
- people lose data
Prevention
1. check it
## A2 - Second
Only line.
# A01:2025 - Again
New text.
### Prevention
ignored before any bucket
Examples follow
* demo one
Types
- kind
"""

RISK_MARKDOWN = """lead line
## Overview
What it is.
## Risk factors
- loss
- loss
### Prevention
1. patch
## Attack scenario
someone tries
## Risk factors
* fame
"""

RISK_HTML = """<html><body><p>Lead text.</p><h2>Impact</h2><p>big loss</p><ul><li>fame</li><li>big loss</li></ul>
<h3>How to fix</h3><ol><li>patch <b>now</b></li></ol><h2>Impact</h2><p>later loss</p>
<h2>Impact</h2><span>no items</span></body></html>"""

TOP_LINKS = """<a href="/Top10/2025/A02_2025-Weak_Keys/">Weak keys</a>
<a href="https://other.example/Top10/2025/A01_2025-Open_Doors/"></a>
<a href="/Top10/2025/A02_2025-Weak_Keys/">Weaker keys</a><a href="/Top10/2021/A03_2021-X/">x</a>"""

HEADINGS = """<h2>A01: Open doors</h2><div>d</div><p>Shut them.</p><h3>A2 - Weak keys</h3>
<h2>No number</h2><h2>A01: Open doors again</h2>"""

SITEMAP = """<?xml version="1.0" encoding="UTF-8"?>
<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<url><loc> https://g.example.org/cheatsheets/File_Upload_Cheat_Sheet.html </loc></url>
<url><loc>https://g.example.org/about.html</loc></url>
<url><loc>https://g.example.org/cheatsheets/plain-page.html</loc></url></urlset>"""

DIFF_INSECURE = """diff --git a/app/view.py b/app/view.py
@@
+KEY = "secret-12345"
+cur.execute("select * from t where id = " + uid)
+app.run(debug=True)
"""
DIFF_RENAME = """diff --git a/app/view.py b/app/view.py
@@ -1,2 +1,2 @@
-totl = 1
+total = 1
"""
