"""Hand-marked pages that the block classifier is fitted on: a block of main text begins with MARK."""

MARK = "¶"

PAGES = (
    # a news page without article element
    """<html><head><title>x</title></head><body><div id="cookie-notice"><p>We use cookies to improve our service. By going on you agree.</p><button>Accept</button></div>
<div class="header"><a href="/">Harbour Post</a><ul class="menu"><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li></ul></div>
<div id="content"><h1>¶Ferry line to open again in May</h1><p>¶By Ada Lund</p><p>¶The ferry between the two islands will run again from the first week of May, the council said on Monday, after four winters without a boat.</p>
<div class="ad">Advertisement: shoes for half the price, only this week.</div><p>¶Repairs took longer than planned.</p><p>¶"We had to replace the whole hull," said the yard's foreman, "and the engine after it."</p><h2>¶What it costs</h2><p>¶A single ticket is to cost four crowns; children travel free.</p>
<div class="share"><a href="#">Share</a> <a href="#">Post</a></div></div><div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Storm closes the northern road for a third day</a></li><li><a href="/2">School wins prize</a></li></ul></div>
<div class="comments"><h3>3 comments</h3><p>Finally! I have waited for this since my daughter moved over there, and the long way round takes half a day.</p><p>Too expensive.</p></div><div id="footer"><p>&copy; 2021 Harbour Post. All rights reserved.</p><a href="/imprint">Imprint</a></div></body></html>""",
    # a blog with the elements of HTML 5
    """<body><header><h2><a href="/">Notes from the shed</a></h2><nav><a href="/a">About</a> <a href="/b">Archive</a></nav></header><main><article><header><h1>¶Sharpening a plane iron</h1></header><p>¶Most irons leave the works with a bevel of twenty-five degrees.</p><p>¶Work the back first. It needs to be flat only near the edge, so don't spend an afternoon on the rest of it.</p><ul><li>¶a coarse stone</li><li>¶a fine stone</li><li>¶a strop</li></ul><p>¶Then hone.</p><pre>¶angle = 30</pre><aside>Read on: <a href="/c">How to set a chip breaker</a></aside><p>¶When a burr can be felt along the whole edge, turn the iron over and take it off with two light strokes.</p></article>
<section id="comments"><h3>Reactions</h3><p>Great post, thank you. I always wondered why mine would not hold an edge for longer than a week.</p><form><label>Your name</label><p>Leave a reply</p><button>Send</button></form></section></main><aside><h4>Newsletter</h4><p>Get one letter a month with all new notes, no advertising and no tracking.</p></aside><footer><p>Powered by a very small computer in the shed.</p></footer></body>""",
    # a page laid out with tables
    """<body><table><tr><td colspan="2"><a href="/">Home</a> | <a href="/f">Fishing</a> | <a href="/m">Maps</a></td></tr><tr><td><a href="/1">Rivers</a><br><a href="/2">Lakes</a><br><a href="/3">Coast</a><br><a href="/4">Links</a></td><td><h1>¶The lower Ister</h1><p>¶Below the weir the river runs slowly between willows, and barbel lie in the deep pool on the left bank.</p><p>¶Best months: June and September.</p><table><tr><td>¶Barbel</td><td>¶40 cm</td></tr><tr><td>¶Chub</td><td>¶30 cm</td></tr></table><p>¶Permits are sold at the mill, which is open every day but Sunday.</p></td></tr><tr><td colspan="2">Copyright 1999 <a href="/mail">Webmaster</a></td></tr></table></body>""",
    # hardly any markup
    """<body><h1>¶On walking</h1><p>¶I have walked the same four miles every morning for eleven years.</p><p>¶Nobody asks why.</p><p>¶In the first year I counted gates, in the second one trees, and since then I have counted nothing at all and seen a good deal more.</p><p>¶Dogs know.</p><hr><p><a href="/">Back</a> <a href="/next">Next</a></p></body>""",
    # documentation
    """<body><div class="navbar"><a href="/">Docs</a><a href="/dl">Download</a></div><div class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Run</a></li><li><a href="#c">Options</a></li></ul></div><div class="document" role="main"><h1>¶Running the server</h1><p>¶The server reads one file and listens on one port.</p><h2>¶Install</h2><pre>¶make install</pre><p>¶Then start it:</p><pre>¶served --port 80</pre><h2>¶Options</h2><dl><dt>¶--port</dt><dd>¶Port to listen on; 80 if it isn't given.</dd><dt>¶--quiet</dt><dd>¶Write nothing to the log.</dd></dl><table><tr><th>¶Signal</th><th>¶Effect</th></tr><tr><td>¶HUP</td><td>¶reads the file again</td></tr></table></div><div class="pager"><a href="/p">Previous: Building</a><a href="/n">Next: Tuning</a></div><div class="footer">Last updated yesterday. Built with care.</div></body>""",
    # nothing but div elements without names
    """<body><div><div><a href="/1">Start</a></div><div><a href="/2">Prices</a></div><div><a href="/3">Contact</a></div></div><div><div>¶How we bake</div><div>¶Our dough rests for thirty hours before it meets the oven, which gives it time to grow and gives us time to sleep.</div><div>¶No yeast.</div><div>¶The flour comes from a mill four villages away, and the miller brings it himself on Fridays, usually late.</div><div>¶Salt, water, patience.</div><div>¶Loaves leave the oven at five in the morning and most of them are gone by nine.</div></div><div><div>Opening hours</div><div>Mon-Sat 6-12</div><div><a href="/map">Find us</a></div></div><div>© The Bakery</div></body>""",
    # adverts and teasers within the article
    """<body><div class="topbar"><span>Sign up</span> <span>Log in</span></div><nav class="main-nav"><ul><li><a href="/p">Politics</a></li><li><a href="/e">Economy</a></li></ul></nav><div class="story"><h1>¶Glacier shrinks by a third</h1><figure><img src="g.jpg"><figcaption>¶The glacier's tongue in July.</figcaption></figure><p>¶The glacier above the town has lost a third of its length in thirty years, a survey published on Tuesday shows.</p><div class="promo-box"><p>Subscribe now and read four weeks for free, with no notice to give.</p></div><p>¶Its meltwater feeds two rivers.</p><div class="related"><h4>More on this</h4><ul><li><a href="/r1">Drought empties reservoir in the south</a></li></ul></div><blockquote>¶We used to ski here in August.</blockquote><p>¶The town now plans a second reservoir, which is to hold enough for one dry summer.</p><div class="advertisement"><p>Sponsored: The best insulation for old houses, fitted in a day.</p></div><p>¶Work could begin next spring.</p></div><div class="newsletter"><form><p>Our morning letter, every day at six.</p></form></div><footer><div><a href="/t">Terms</a> <a href="/pr">Privacy</a></div><p>A company of the Valley Media group.</p></footer></body>""",
    # a recipe
    """<body><header class="site-header"><p>The Small Kitchen</p><form><p>Search all recipes</p></form></header><nav><a href="/s">Soups</a><a href="/c">Cakes</a></nav><main class="recipe"><h1>¶Leek soup</h1><p>¶Serves four.</p><h2>¶Ingredients</h2><ul><li>¶3 leeks</li><li>¶2 potatoes</li><li>¶1 litre stock</li></ul><h2>¶Method</h2><ol><li>¶Wash the leeks well, cut them into rings and sweat them in butter.</li><li>¶Add potatoes and stock.</li><li>¶Simmer for twenty minutes, then blend.</li></ol><div class="rating">4.5 of 5 (12 votes)</div></main><section class="discussion"><p>I added a little nutmeg and my family asked for more, which never happens with soup.</p><p>Lovely.</p></section><aside class="widget"><p>Cake of the week</p><a href="/k">Plum cake</a></aside><footer>Made in a small kitchen</footer></body>""",
    # German, few names
    """<body><div><ul><li><a href="/a">Startseite</a></li><li><a href="/b">Verein</a></li><li><a href="/c">Termine</a></li></ul></div><div><h2>¶Sommerfest am See</h2><p>¶Am letzten Samstag im Juni feiert der Ruderverein sein Sommerfest, zu dem auch Gäste willkommen sind.</p><p>¶Beginn ist um 14 Uhr.</p><p>¶Für Essen und Getränke ist gesorgt; wer einen Kuchen mitbringen möchte, melde sich bitte im Bootshaus.</p><p>¶Bei Regen im Saal.</p></div><div class="hinweis banner"><p>Diese Seite verwendet Cookies, um Ihnen den Besuch angenehmer zu machen.</p></div><div><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></div></body>""",
    # a site header with prose, and a legal notice
    """<body><div class="masthead"><h1><a href="/">Quiet Lines</a></h1><p>Poems and short prose, every other Sunday since 2009.</p></div><div class="entry"><h2>¶Ladder</h2><p>¶My father kept a ladder in the hall.</p><p>¶It led nowhere. Still we climbed it, one after the other, and sat under the ceiling like swallows.</p><p>¶Later it was sold.</p><p>¶The hall looked wrong for years.</p></div><div class="tags"><a href="/t1">memory</a> <a href="/t2">house</a></div><div class="pagination"><a href="/2">Older</a></div><div class="legal"><p>The texts on this page may not be copied without the author's consent, in whole or in part.</p></div></body>""",
)
