"""Pages written for training: what lies between the two marks is the article."""

START, STOP = "<!--article-->", "<!--/article-->"

PAGES = [
    """<html><head><title>Harbour news</title><style>p{margin:0}</style></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact us</a></li></ul></nav>
<div class="ad">Buy two lamps today and get the third one free of charge</div>
<!--article--><article><h1>New lights for the old harbour</h1><p>The town council agreed on Monday to replace every lamp
along the northern quay before the winter storms arrive.</p><p>Work starts in <b>October</b> and will take about six weeks.<br>
<p>Boats can still land at the southern side.</p><p>Fishing goes on.</p></article><!--/article-->
<footer>&copy; harbour.example.org &middot; All rights reserved by the publisher</footer></body></html>""",
    """<html><body><div id="header"><a href="/">The Garden Club</a> <span>a place for growing things</span></div>
<div class="menu"><a href="/a">Plants</a> | <a href="/b">Tools</a> | <a href="/c">Soil</a></div>
<!--article--><div class="post"><h2>How to prune an apple tree</h2><p>Wait for a dry day late in winter. Remove dead wood first,
then branches that <i>cross</i> each other.</p><ul><li>Cut just above a bud that faces outwards.</li><li>Leave a clean edge.</li></ul>
<p>Step back often and look at the shape of the whole tree.</p></div><!--/article-->
<div class="comments"><h3>Comments</h3><p>Great advice, thank you so much for sharing it with all of us!</p><p>I lost my tree doing this.</p></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href="/1">Pear trees</a></li><li><a href="/2">Plum trees</a></li></ul></div></body></html>""",
    """<html><body><div class="cookie-notice">We use cookies to improve this site. <button>Accept all</button></div>
<header><h1><a href="/">Daily Review</a></h1></header>
<main><!--article--><h1>A quiet year for the railway</h1><p>Passenger numbers hardly changed last year, the operator said in
its report, although freight grew by a tenth.</p><blockquote>We had expected more, a spokesperson wrote.</blockquote>
<p>Two stations were closed and one was opened.</p><!--/article--></main>
<aside><p>Subscribe to our newsletter and never miss a story again</p><form><input name="mail"><button>Send</button></form></aside>
<footer><a href="/i">Imprint</a> <a href="/p">Privacy</a> <a href="/t">Terms of use</a></footer></body></html>""",
    """<html><body><form action="/search"><input name="q"><select><option>All</option><option>Books</option></select></form>
<table><tr><td><a href="/x">Index</a></td><td><a href="/y">Authors</a></td></tr></table>
<!--article--><div><p>The second volume begins where the first one ended, on a bridge at night. It is a slower book, and a better
one: the author has learned to wait.</p><p>Readers who liked the maps will be pleased to find them here again.</p></div><!--/article-->
<div class="share"><a href="#">Share</a> <a href="#">Print</a> <a href="#">Mail</a></div>
<div id="footer"><p>Printed on request. Prices include tax where it applies.</p></div></body></html>""",
    """<html><body><nav><a href="/1">One</a><a href="/2">Two</a><a href="/3">Three</a></nav>
<section class="promo"><h3>Special offer</h3><p>Only this week: half price on all garden chairs and tables</p></section>
<!--article--><article><h1>Bread without kneading</h1><p>Mix flour, water, salt and a little yeast in the evening.</p>
<p>In the morning the dough has doubled. Fold it, let it rest, bake it in a closed pot.</p><h2>Why it works</h2>
<p>Time does what hands would do.</p></article><!--/article-->
<section class="comments"><p>Mine came out flat, what did I do wrong with it?</p></section><footer><p>About us</p></footer></body></html>""",
    """<html><body><ul class="breadcrumb"><li><a href="/">Start</a></li><li><a href="/k">Kitchen</a></li></ul>
<!--article--><div class="content"><h1>Testing six kettles</h1><p>All of them boil a litre in under four minutes, so we looked at
noise, handling and price.</p><p>The cheapest one was also the loudest.</p><p>Our choice: number four.</p></div><!--/article-->
<div class="banner">Advertisement: switch your power company now and save</div><p><a href="/next">Next page</a></p>
<div class="footer">Contact | Legal notice | Jobs</div></body></html>""",
    """<html><body><header class="site-header"><a href="/">Trail notes</a></header>
<!--article--><article><h1>Huts along the ridge</h1><p>These are the huts that stay open through the winter, from west to east.</p>
<ul><li><a href="/h1">Lower hut</a></li><li><a href="/h2">Meadow hut</a></li><li><a href="/h3">Spring hut</a></li><li><a href="/h4">Pass hut</a></li>
<li><a href="/h5">Saddle hut</a></li><li><a href="/h6">Upper hut</a></li><li><a href="/h7">Summit hut</a></li><li><a href="/h8">Eastern hut</a></li></ul>
<p>Bring your own wood.</p><table><tr><th>Hut</th><th>Beds</th></tr><tr><td>Meadow</td><td>12</td></tr><tr><td>Summit</td><td>6</td></tr></table>
<figure><img src="a.jpg"><figcaption>The ridge in March</figcaption></figure></article><!--/article-->
<div class="comments"><article class="comment"><p>The spring hut was closed when I came by, so check first.</p></article></div>
<footer class="site-footer"><p>Written by walkers for walkers</p></footer></body></html>""",
]
