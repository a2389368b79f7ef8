"""Digests of the canonical forms of full licence texts. Written by make_license_digests.py."""

DIGESTS = {
    "0BSD": """
25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c
53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe
54643a31416c8580fedbfcb2a7715e66c400a262adcbad165fbe1c9671a3003c
55159f5ac07396cfa2bbd63d81befe78dfe6d427c1797bce2ee8b2c000566ae3
9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153
""".split(),
    "AGPL-3.0": """
16e7897593337b022be2858fa8d11f88497e773f0789b3cd7d0e4f13a38eed77
""".split(),
    "Apache-2.0": """
045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847
108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87
2136ccf013476faf84009ad5c667369e6718de5a3d755f97ad14c74f000e9f6f
46262ed7a2a06fdac885b37f111be9b18bbde572ab1edbd2f416d673551ab967
62c23944e22c7e1579b00eab372c8062d04f03e360aaab08b4030b71d5eac153
b0a60aaffc83b2bdcebe90ae6d33365e374a9bf69e8c2e80c0e8c51256d4fc93
b35b83acee1925f4ac31d46b381bc9d2c40dc1a05e2f34d5dabb988b86b42ab6
b3b9336d65edf5556d0a2b4e3ad60eb60e7ee0e240d342b7ce6dece24ebd4678
d8221a4f10c01c6fa5390685929a5ce31d7264a024162fd3dd4d805c57ce0f43
e4f2e540d2c4e13a29b650556674e22c46458abf8f8a803515dbc447d9d77ca2
e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2
ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84
ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c
f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0
""".split(),
    "Artistic-2.0": """
1a437a5db780632439a4c5149db6a45aba8531e1b1ec012ce51b6ecdc9a494c8
a5f62b641c73cfa7e7a06bcf206ac0f0758ef9401a79636f7c49e9ae8ce1f113
b257d8b6a7c9138e5f9522ec5947f70337943d884e7d25a78b34fd817a39de04
ba4d7b72eb8f170295b02ee4f5f17e40a33a5e25aaaa13a849338f7d8ec1857d
ef673bda60ff86d93e435501b0dd59d8122a19f7be90131e61d4ce6c5054a465
ff062107d0f672fcd2ad203df815899e2d4cdf6936a40f33dc40924e7d784baf
""".split(),
    "BSD-2-Clause": """
107f8ba0af742645bf7864695e36616fbcaa19b8c1ebb01f30fac7dd4011913a
23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2
2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7
2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071
447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2
4ede70430bf3b227c2dfb5d047a5c3491e9c45d1f525491374ce169d89856024
7c34d5446f49096250652f747457c4f05f648d77b0bd00663b594740c7fae9aa
90d48255144eaa2455264d0af9ef20ac2d4b728bc2fa878ea3059038a0bba60b
986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74
a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30
b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893
b7a2aed1fa065cd606a9a031c76bbda14762c5ee42dc79ffd671ad56ff168604
bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07
c817b4992e3efcf58b4d313739928808f3b0c9dfa7f34f3bb5163f39ac03121f
d49335063b3b80bcd045d226634790d754afeca4ebc3f78f90dd2c55fca07834
dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642
e3bac387d3e0531e153b6a34c7c0db19027267c74faea9e4e3e2d45c511eed04
e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9
f70e318812c2186c966e06dbe61de79ef179650c6b6b0763f3571effcefd5ab9
fb99f9c35500c071a9fb216cf951e023b13b20354051dc781de1ffcec2dac248
""".split(),
    "BSD-3-Clause": """
214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997
21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651
52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45
53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa
5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0
6cd2ec4c1707d264427cffd6a4120fb4ce726f221152e3e5c63f8b57d2e1693e
6f922c6cb2a22faa1c3d9be59103bf5dc2942321f1c76cc3b6f0772aa184826c
9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2
ab96d546e6cc543d5b4293c719e371f5b0d14297d55a21baa6643452a92007ce
afc81ee99a150bf9ad976d1b4b3bae3ec8fb30e82c7f9ec18d0048b070d2ebc8
cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15
ceb36b0173297578925e297a5e163a7f0f988327f28c8eb9654153d4354b2598
d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060
d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590
e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54
f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af
""".split(),
    "BSL-1.0": """
4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85
5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded
88376b33b906f9c611252122226eaa228686ae5885340c69e5c685fe59ac4b39
ba411d560418eec8d155b1bf59e53734f541d08e6280665a063063c2cc712183
""".split(),
    "CC0-1.0": """
471f66547bc4cdf104c87ac5a818b67290c55a6942ec3d079c1554eb5a6d7664
4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152
7ea83353f6a48443a673f3c4eb58917fd6c45b5b9322ba1c20fbbee6cfc5d526
96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f
a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32
bd603030b6385d973f65493a99468780d1faae61c77a5841757efb871cc902c5
""".split(),
    "CDDL-1.0": """
33127db5fc21585fc96006572142d02ae3c83b65f1ce75bb1890c4415f7d2c85
5d8babf98deb6694d320f70feed868d584985ce573823ae679d4479daa087922
f30b6a411f9b7b79488e3baaf5f2933a3ce71cb3a098e9273971a7f719c4bc1c
feafbdf8c6cdafb32fc2dca4bec328d9af036b670d6e1986f1b60a26b5866f01
""".split(),
    "EPL-2.0": """
008fb04277de491ac391255f4c173bbea4f169e81d2ced4c924c7caa0c7826c5
0f33b884ed16e953d6d4e0febad7673c4c1c8fe8fa69bc045fecf443ba8bca0d
3a30982c69d6a418c51386342e07bcc7e6bc58fa63acd5b4b5d7a126148fa73e
3b6fabab64158336d9a33eaa6b1925fe70d79e20ba2da50b6a7e220c38e625dd
3f0940832a6ad2bb0c8e9f8a8b3fad4427b43e6b2a7110ce5f8c4b1420f8804c
8fbb910251c24acd487b634ceb37457ff21d40aef11bed21e8bfa194397787e9
90a65326bf74c1a80b74cffa85dff0ddb4a9af3957c6eede6c6fdfe31d488452
""".split(),
    "GFDL-1.2": """
04ef6dc34115806196d88d92e03f52b97ee22cb01cc73a59c06b30bd55f544c0
15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b
1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f
1dbd72b6f124a1058e786b52a9d4afe44543b834a3aa44faf6c18b747c9de8e2
2388b35d79f88f97f735cdfb8be8acc23280711514529978420d8df1d6c00362
2ac25285928a9ce6a8bde0e68e6d8ed774475113822c19df30f2474f15b171c0
33e7b0c926b6b183f54237ad056a663d10fdbb688e1b34a2c0b2d2167ef7b2ac
35ae67113854c89d267fca97775f50c442bcb8b5380e884e6a2b0b79295a8ea3
4586dba5ddfcf100fb8904f8e9ed3b5c8475c6a35c144d40b2c7904ea874cef1
587d2eba87ab80a2aaa7b5f1c5b2d444f26a008dc483dafb38e27162fc5c2b7f
5c083164ec08b233a6e2819c8c6d4f66a18fb74372858b0f8f418511dfd7adc0
63010df9e01317a049c4911c8bf71d5557c0e38791419fd9853bf91dd13ded70
640ac86d192efdf1e2ed963445d1363a94479525fa904e6bb2eab8a50979dc4f
7dd9471bc1af62aca23bb4cdc8d3a9e78c0c4e57103d0d753be748d05edbcd5b
84ce1e08ecfd175909b5f1a7df90cd0a11e499c1de5accb1fdce50ab69d99de9
8d08c74cec4dc000cf7c1c2967e04c1f2cfbb7b005c9db69c29b0fa77e4da921
925dba96dda1b00cd8ff146661df40b6b2a302af5bf2f1243976eddb6d5a8450
994588f2266d45ab1e8811370fbb190009bebdc36ddc540d1ccb8fd6a392977b
a2607c0e38bcc0296add0ea58ccf09e2cc4d92b7aeb27c849b44435df616b905
a5d55fd7bf2b1cffa2a90fd61efe200f197c552547909b639a5c9555a1fdc71d
a65cab2bcaafc465aa9272d67eb31964264720eb9a8eb518aa8d11256e6d3682
a7278b28ae1fca0d0e806267dc2a636e722deea44ad03f362339d2953f7a63ca
b9843e40d4accd0616d01f52f495d06e17368e7ac16e5564aed546e43415d080
bad93ce38840261d44664fb0c23ad0451c14b7b49f3108ac5d196b7d6fac8a10
ce1687e4173ca953a64439bbec062fac9d3f5ff90129e3a7405f6f345e1048cd
d122717463c92ec73b4f029063157b12ecfed86bcab80b9ac86ca62fc1370778
db6f09831916c5579e026e27258750ad20217e2fdecb30d0d8730f2444777abf
e078a7e8620cd0cf62ca224a8d44746755f79bde8c966eaee25db83b042c9a4c
eda7501709d9bbb7545c3457b23433efc97abfe963735675c38e624b70733530
fc8a37355e09c667e073ea57851209866258a9b109fcc4955a26414deb2f34d3
fd90ab14634bddf04e61ca043b724446fe597d1ba0b4a8f0e3f4e2fc84522693
ff70e77ff7419e7e0bdabf1b1173d9bcd37fcc97783d0f79bda24c836e9d2ca0
""".split(),
    "GFDL-1.3": """
0cb0736777286efc71748df95c0748e42cbf34246d31f42e488fded6114061ce
2d328b8240a295bbc2d9b77bef84c19ca01d38c19c33d474a6c9482cbb6b9515
2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d
68444f62da25a6bdc866882b55ca255b5530bdee9f7e383e08af2b77054e7f8f
7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7
911b9e1b02471fa9b19ec482d019380acd7e0fef00ffbd4395e8813b06533fe7
be68d33be24e4896ba28149c4f384a1bb29f6220b748d8ae6a580d56b0f62445
fc6fcfc8a09b787d46f5061823461cd688e3982c62447eb912f448250a3f1238
""".split(),
    "GPL-1.0": """
2360a1b8fc5b5a8b1db5f560a193fbbc23ee8a553de375a1c8fcc5805d683848
40bfd04fbf3c8d830020922312ae96bc87a830c99d039072b3b0a2381e90dd3a
4a0d740eb4453dafe0e6d04e2d2e4f04c7c85bc1fbef96bc056ea93e7c1c36bc
534c6ebf14c4c67a730174ff845b6dd8d84e88d8cb58a6d856feb8491b78ae8e
5d04efd5064c00f9bae91b82b68bd4bd9845620d93009bf36072f27633c676b2
5fcc149debc187a5439faada41342d88a9040d1fed00ca78f543889aa201bb79
6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc
654ccf2c4d22828f80b08e57df67bf8a8dd1693331cff835e06f8042124c3370
733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5
7ad2d4b030292e9bd75409f5b75517e2c3d3a9a2ba3255d92c4211aee212c58a
7b86297a2762700b078231c8b488809b0f63cac5e298d74f4270d251bbef230f
8021668b598cf89806d3e2a446601adc80c2a7f62a47d82342031da7e857e8d0
81bd9efbfd9b1420ee71c16f433ae083dff4355fc903bc884f978a6d3ff7fc64
8614c75305372da07d61066dd74c4f35bbd4ed7c93bbda34a8dc96d1fcddc152
8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224
a87d2335c7c408f93c15dd6892a723a61b2645ff1ad65619233239cce6bd570d
ab14e48cd2a766aa9942b55715172ef4d4f4c4e6b3d0c80607336b312d92619d
ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697
b1760bf307390061742600594a54c5dd007242ae734df09d72d1086b3b16b1fd
b80c75f62f77e4b5c92f32edee9a5be7c924cc651474d90840fecc602674a983
b8b167b35ef487131786ad1bc3cf81b217124f81f7408c3ccfff21ba946bb0e0
be47459d4de292dd05ccf79373129bc9009f77c758ff5cf61b6ac7aaf7a8e885
cdbd45c61854c1e2790a3fbe3e5255711676eeb616f2cd64d0584130cfd4785c
d8699e6bd21341e8975d442ec5dd3a1ae21c45867386daf3557519f3e68705c2
""".split(),
    "GPL-2.0": """
01fb54bbeecb4129fbe6ad8f9e17f75e0e6746efafca1b4fc03d2a5b9d8059ae
075bcb76902921614c275e6562daee18b3c9f48b9c4c92b8b99ba3df00093abb
0dc0016090bd0e477ccdf0e78d593094b669742ce126c4b7cb035ea6e6443afb
1188bd946c8b086fe6ea384131bc5e4725728e74e0fe1902762c9c87ec4bd36a
1984fcc2ea465ff2dfc19786e9f3b804a814faaf19c82c0857a3190a446523ce
1b00cde680972af3a964062abf5cbc344daf981b9bcff219272d872c2019d5b3
31e3a62a681ff21a505853d6386634ecebd8c7c24dd9cc22fcf962977b5548b5
4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3
58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd
5f3bcd48294d593b7647e36010d614bf45bfe3e5950aa6673782a092bbacc1af
71f3bc98cacf711b6e2ff997b37641e59cc5bf623e7c0f0e8343aed2626f4ec9
724c8299687866f11de217ce9f08e16805bc84b71e66d8c4ea1307d371e33a4f
8630277a8949dcf93f5a3e8c0ecdbb7e4a7f92462abe31e00801a63ecba62e23
8761fe7162dba1fddadb2c2adff14c1d63d51bf3a946123eaf1e63cd1396e391
8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2
b0dfa528deebaa3b03e925cbdf218bcc35d0d6060bfbc749c47eaa01972287ee
b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774
b1c5aa1739d6987e6a07d17aec22866668fd58e96c5bf8b42f8885db04de1a31
ba8b5323b72bf2f2c5d07074133b38292e0fa23fde8fa48771ba8a04cccacddd
cc5e906da6be25c1bd7043d43b6ae593952ed18b205716a7cd5c93213491d778
e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34
e9004779fd94929c253c40235c3c24c07f92467f2d376b936ad713d57d2cffc5
efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821
f285bc3733cac5b521b9507129b185a5f644847c954d9c5081d2405c9043b624
""".split(),
    "GPL-3.0": """
04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3
4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19
a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68
ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636
c50bb15c5f5e96b27d60ee792a7db1637c2e416eb98869999aab5af68506cd64
eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a
""".split(),
    "ISC": """
217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a
280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29
28b3b76e4bc702261e30cad89a6515298ec241a0ec504c0153b7c6910cd2f827
2b614fb2c18253fb7c1d5d24276593e12d81b854b5e79442a26885adc7ddc0c0
2c5674d617d20196b487c7b0608b9c209df7c111c557c8207f2fad989914586b
2f7ff835ad84c784a0716913eaec1339ce1b7ca3c06c16971c8e8950cccc6414
30fe7ddd14f7f6d7bce47da437bac0dc1a88496b90a9be0b1bad8404b114c011
3befbb2a7236f8cca831fb417515d0355021b92b4ae3ad84a9504b30215b727d
3c094e9c7072025f416c19903d3f8c435095de9b51bfac84d6c57e84483dcee9
3d522e40b21fe47f1c0b4ba98d2813c76a08e24b8869559e32371e837ae9fa78
40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db
571c6f1b092916ec5c47890bbd34b8d9b81d53924bf0295cce6fc61732751ea2
66de9dcb5bbe1dae3a7b5c7eea78ef0f5daaf46d237cd6b3b03e794659954c4c
673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317
68cd3b9a1779ba2e8eab1875d0cbaf9b66d4b5bb00a2d65f98d027ce9d50d2ba
7bed11ada181e6a63598e2da423080dd990b5647feaf0f67008662a131aec2c7
88b7717fcdd81146db5806f169a2882599b1b6575d65b88971edaa913b7dbfa4
8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f
a78358e4932ba3093f235e64ea2769b9b05e4e6f17c4ad7ee404b2efbf5e1b3a
b2e4e0af769b11c40106718835270bde227329e1bd58ecdf851707a7c2c1a692
b8bccf071a9e4caa2fa23a130c6e25fe4ed53dd1750c125e06a7712517f3a50e
c372ed4ac57c4fe92983143d1c292c964b7eab9f9836fcdb124c2bc0c9e83940
c8dc4820b7294d311a05f9458126f473d2e604645536d64bac2b3e70f83c6d3a
cc9b23110c1c8e319dde4d36f90f7f67a0aceccac0ce41c48af416b80a65c072
d0a46b711003fa64af35e534578d9f833ba20250bacd25291672c813103c1d33
d8ca84128f00bae40f45c9b35bc69e917d4fcd65e71927bc42818061289b9d42
dd20ca7f0f128eaf02cf7ecc69098fffb747ba179eba3e3735a73e67febfa360
dd737b7f02b585d36e67c61e03203a1535c4dc1146082a5098c944f4d559453c
e8a0275fb9678207a4f0f1b5aceff3bbf0ce0d5b784ed391b3a4bcf0b7ace58a
eadff78c959800f94ed84e4c2026527fc6b4b5136e51da305eaa4d1f0ceaa62d
f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee
""".split(),
    "LGPL-2.0": """
084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2
0c06832b02eec62268b6d8040ddbd7dded0458e499ae7118d35ac54fcaab1f3b
37fe41bdc706a9d330454293e89edd7bb1942b127ab3e33a95d18ac0ea28a4b7
40e1e6ef14eddc03760301819a63fa82ecc44ba2b43b430c1b9b7f51e5454175
4267d994f8c02ca4ef8e1b0ff4cbc23bbd6e3a92e635af26765abcc108701db7
504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260
542237188ef845a737d1eab5621ecfea8c3310f513f6ff72ad59d1d500e84b63
5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b
61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908
6bcf4fae5fac3aedfa4dccf6248ea48bfd1ee53edd8f1191a4970c156e10141f
6c3bb51c96b2900754a1c65123677aa74c9ec1548193a3d0bac6240c6847f8f8
81ecf332fc652bb79c23397a1431c72d1f39f01ffdcec61843942283b44f4688
882d0602058133b70e56be6b95ceb92d8d460a9d52f5541d9fc924ea10af7f97
aa06ce7f6e464e73e65ec0efa0bc575ef5bb7059ae0137ab610c2e57b32ca95c
adda62b7d3feb92fbb1e301137a27eff0c84ff4a799b7732b44f5e701f8acda1
b8ea073e439726473d89fe7079f3986c7065d075935ea802950973adc3ab1055
cb25e5e1095347e992d553a6b90ba28c3eb94162214d5bcb01d79a61f270448e
cfdb5c66c66bf96ca974b33dd3db756e6c7eb3329f999c38c122137bdb4be319
d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108
d6ef0358155ba2bbfe03a0ad7bd0c8f55b38c0b2d8a92c13bacb4a3631a294fa
d8f786929d4cd5e353f34a8b5fff503ac6cad8e24ee35ceb9eea0d2298b7b4ef
e722a48a269f88d5d26a630a9e1cdfd4495c01505fe8703f6e6748b4f092828f
efe55a938a61c4a37a0586d48a0ba7d2dd994fb2c79982bf1a38c2d6d2635a80
feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380
""".split(),
    "LGPL-2.1": """
081a6ecff0c8e50ab92b129954441c5d8fbc8f1f5a8987bf8d9225cde97aee2c
0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87
0e70bde79a72ea6071aa23f735a8c6c99f8eb3c22ddd65279dc2aa8f01a312d1
1246388d7683386b80d5bc3d760284895b628490f9a4e36d56f9e2ff0337dd8f
3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169
45ab1a2a290e74e8c905ed1fbb6a81f1d48fe964330aa7855ba1aa1f88306f09
48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4
4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891
580d668437368921310389889745ec2a76860b0f634a684ce33c6a4e5d106957
5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a
66eba6a3269fa46e0d45df438c0597f019cf9ee220ad4cdb37394484bd13b088
75fd50abdf9b6ede6e1241986dd3e5850aa7c83b83892f5bce9e206765724836
77e5acffdb4b83d2e3ef8f1feb41cc7d5c859e0f7b2a31236b807ddc4248f9f5
98c3badd328e41935b497c104ec34622a1957d223c842d26a1838cdb1d70b452
98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4
a19848dd8a66913e5880ee7b53afe86b97c83c8b7dc01d8d696b8376c4784067
a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47
b11e56f26e36c27490673d8fa272b68666cfd474b64e23db5244d0ccde21fa9e
b3de6e6f4377549f6ee2b737203403c9e0e029d49f0433e62a4ab6ee7a5329f2
b4c9138abdf2bff9e518e6ecf59ce4aee00f382e3000c2e4065fdd5233d11816
bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb
cb12434d1b0bf73c48155fe7934d08dcc73a385848ef79cce6fd7cd370cbdc1e
d6a996bdc3e4d60589ed6eb838f42f4b6dc6519aefc0bbb4cb6d7401cb20109f
e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9
e94f6c31379c2076fae91e236d6000ea55d918637fc8f30749aa0fe22a265c7f
""".split(),
    "LGPL-3.0": """
13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7
aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be
""".split(),
    "MIT": """
0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c
1a1db7ea5b6a7a16ca81364fb122204fadcc82f415045e2d7f067f4ea078e5eb
34a7a77651e43abd07cbd9c72cb035a5ba951ada4af819f95d6ca6fcfab5813d
35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164
38ed6a717bb7f453bd96525eabcd93458de42d87cdf4602b4392b0528cf6175b
6733127d88b7d3bd59c42da120690dbdff1e658acf3fa3e2448092079ad6999a
6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f
6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127
7fc264ddd0eae7563cfc340315d06557c3cb395d713a3ca11bbe10391536dab1
e94a78da9df16f4a9c0a40015bfdca38db305db8c7a415fcd98a243b16607600
""".split(),
    "MIT-0": """
a181c333030f65ebcf2eabeca3493225b6b03fce6907bdd3e59e7a8a37180fbd
ea701ff4959a9d345487cc9c0ea90c4282235e7053eb61ada90e8c95f484bd04
f02e38ce878ac35aa36def58139ed31da3eef4c9e9c1ab4b3751875d209d21f9
""".split(),
    "MPL-1.1": """
2772c161a7ca5eceb4517ee311d5ee8b30c97502771ed5f826ca5e3856ad5c11
3a6a0fe0030e6e755a04923126594a93aa582cc0213fe0e705392a915b23ee31
3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1
4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d
5f65790f99e609a9152deed8a1ad32c76ba56e2cd93b039597d4265afb177c60
80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87
8e0d6bce1c9edcccd142522e83c6de084a68b9500d79e6741b8903df3316c55a
979f7243204c7078aaa4d4e66ddf86160e3bfb3a2d6271273e461dc82f604699
a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b
f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6
fb84cdb331a381edd811d3017d5400ac2c74d9d8470038f79413ac78b10c2a59
fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354
""".split(),
    "MPL-2.0": """
075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de
2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04
3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7
8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3
95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9
9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13
c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3
c7625b8590f2bd72af25ea48c9d735f0b781eb75cc74e8419c28c89cb57a87fb
ca15f9cdd3f2fd06a41df42402a3886e1de25f02b077725084c5d8d535cfcec4
e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2
f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a
fa31bb5fe4dacb07f1a4ad162be58edb552e9a96a500b68e081943eb2d3cfec5
""".split(),
    "Unlicense": """
41f84c538b3bc6dcfe6afaab48f6e16c34fd1b11b2c6be7db47873ba3bce291a
4e4a14653615384fbde1159ab26f714489017d0fada2237d9df5c979a538c7bc
6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf
7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd
a85d2f83510bab5c6d6074ce1633e067a6eed07b6edc45d41ae264a0ea78af76
d7ef23de23a66be0e3fdecee1f6bdf9f3d78ae8b5f45a1085c6bfae0eab283bd
fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff
""".split(),
    "Zlib": """
1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7
650ad42ca78a7de669d6cdb6370d08407db85fb523ec1120eac8064af9d15be0
6639a2a838439b2f70d60db893a595aca137c59bd50f4b6f5ec2be9ada5db66e
8c81ff67b5987d3b4f6370ab81f9b187be4db6b537e08d1cb5d36a5a3ba2027f
99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a
9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73
c518a7c648aeb891231e662e2a0f90e29e9d31f3d81e2033d784badca496011b
e8b4b40ce77fe1c6b396712780f759e806aa4252d6177655c74c2f9e80b083db
ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145
""".split(),
}
