"""Published monthly values that estimates are checked against: paper counts and portfolio returns, 2017-01 to 2025-12."""

# AI papers per month.
PAPERS = [int(x) for x in """778 1041 1440 1242 1449 1292 1390 1295 1439 1369 1821 1306 1162 1792 1842 1830 2344 2165 2093 1839 2157 2376 2730 2171 2052 2147 2301 2939 3450 3308
2829 2627 3386 3617 3456 2928 2431 3508 3423 3823 3612 4992 4246 3365 3559 5327 4133 4237 3168 3838 4508 4512 4105 5503 3980 3650 4489 5427 4347 4151
3363 4007 5309 4250 4883 4790 4305 3697 4183 6108 5173 4087 3470 4549 5838 4674 7397 5986 5057 5349 5560 7251 6280 6077 5282 7361 7528 6561 7617 8252
7245 6120 6925 9707 6925 7951 6306 8781 9346 7429 11363 9462 8284 8799 9800 10801 9205 8077""".split()]

# Value-weighted return of technology firms.
TECH_VW = [float(x) for x in """0.0423655779844 0.045681388232 0.0196664922241 0.0215098813994 0.0397802916972 -0.0204582474364 0.0377742336033 0.0279919508366 0.00671082632188
0.0633567953619 0.0134719629233 0.000122799425567 0.0726218188405 -0.00774524704573 -0.0311934198861 -0.00331170970973 0.062636897576
-0.00389218629961 0.0243730459901 0.0631337698379 -0.0046209486499 -0.0833923014144 -0.0072182697813 -0.0817423022812 0.0897045854368 0.0541422511742
0.0372271102255 0.0549804224063 -0.0814144147669 0.0769465916673 0.0359123632408 -0.0198674398213 0.0138503270548 0.0313524489981 0.0519264600068
0.0382033195544 0.0304443021682 -0.0661977342114 -0.09019984876 0.145112685561 0.0726562711408 0.0604895922108 0.0699795707575 0.114050012109
-0.0565450600146 -0.0163804539863 0.107142548405 0.0506536958395 0.00938011767183 0.012123618941 0.00608031448493 0.0582958500195 -0.00756384830827
0.0706632181185 0.0371262098933 0.0484674416042 -0.0631575294322 0.0771934002782 0.0149015564902 0.0211221684903 -0.0860553523642 -0.0462526844087
0.0310112302872 -0.124751656198 -0.0171587024671 -0.084136174018 0.111596444114 -0.0526091636651 -0.115416767381 0.0484870883977 0.0609485008474
-0.0778948785284 0.0967314026587 -0.00378769906051 0.100085196776 0.0017734869247 0.0812256347659 0.0602362917536 0.0384996619647 -0.0186932275367
-0.0604122321281 -0.0198547407443 0.123061379067 0.0458773778809 0.0329262343261 0.058738095371 0.0244392225888 -0.0438112140036 0.080993933326
0.0805699003984 -0.0233082825185 0.0147303308244 0.0292130652466 -0.00487142444657 0.0456478877391 0.0118440606001 0.00501901422819 -0.0339893665329
-0.089271598671 0.00990931505525 0.104667942875 0.0903739251832 0.0515487430665 0.0102331194349 0.0690570825825 0.0550238765685 -0.0229778395924
-0.0070499486723""".split()]

# The spread between technology and other firms.
SPREAD_VW = [float(x) for x in """0.0231851070574 0.0161290621041 0.0206072885841 0.0139908951397 0.0358568685404 -0.0371285948785 0.0193676583923 0.0316429917086 -0.0209271199123
0.0544465188049 -0.0154316479182 -0.0151782266282 0.0268043617539 0.0398048884995 -0.0162097633553 -0.00922195306381 0.0459070988625 -0.0097797605518
-0.00825975079796 0.0451791889593 -0.00606902846232 -0.0117867878374 -0.0326789779546 0.0064889436723 0.00225932862964 0.0267664619598 0.0305081913271
0.0229032428489 -0.0231604853273 0.0120607230049 0.030885775263 0.000904570996575 -0.00190847590454 0.0142709848303 0.0212449146432 0.0116163271343
0.041763508835 0.0138707017358 0.066381596125 0.023646182353 0.0256444557424 0.0452483523917 0.0178966373639 0.056457460192 -0.0274875731156
0.00405927711645 -0.0188570935952 0.00965578343962 0.0114955421122 -0.0222343467875 -0.029136197847 0.01510517528 -0.018966600044 0.0624416209762
0.0382617317227 0.0303875237042 -0.0282983407101 0.0183914242588 0.046824952965 -0.0146270341881 -0.0390461847947 -0.0328240748399 0.00180280107409
-0.0488975360566 -0.0219090081165 -0.00163701897133 0.0318773576008 -0.0226535301958 -0.0314655640781 -0.0356926875882 0.0079364773439
-0.0297057597077 0.032421682836 0.0283787184522 0.100264615437 -0.00881496287657 0.109360202639 -0.00768629948103 0.00285159187516 0.00330035574925
-0.0188945871671 0.0129347472492 0.0422131793386 -0.00920322535006 0.0358848368875 0.0121004156923 -0.0113921384811 -0.00347491572283 0.0488250709116
0.076460597646 -0.0600267882001 -0.00925262186555 0.0111636084977 0.00570000433759 -0.0240776040958 0.0596596564869 -0.0383767257558 -0.0245323390984
-0.0497134148706 0.0189732855023 0.0611804463982 0.0582739765749 0.0457893372239 -0.020769256606 0.0470115295294 0.0526473151412 -0.0366003517816
-0.0122752404953""".split()]

# Growth of the adjusted series in the first months.
X_STL = [float(x) for x in """0.0425201258228 0.216207860698 -0.0623059433566 -0.00390463075307 -0.104330545679 0.215478875266 0.0339322212181 -0.00907284587848 -0.229366729353
0.404641940742 -0.199911318901 0.0972824034086""".split()]
